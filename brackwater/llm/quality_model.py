"""Quality classifier: a sparse ensemble of rules taken from trees, weighted by lasso logistic regression and compiled to columns."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, remainder, shipped, small_batches, text_of

shipped(__name__)

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>@^~_=+{}[]\\"
STATISTICS = ("words", "word_length", "longest_word", "distinct", "distinct_pairs", "top_share", "same_as_last", "upper", "digits", "symbols", "bars", "shouts", "stops", "commas", "line_words", "dup_lines", "other_bytes", "loud_words")


def statistics(text: str) -> tuple[float, ...]:
    """The statistics of one whole text, in the order of STATISTICS; all 0 for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()
    n, size = len(ws), max(len(raw), 1)
    if not n:
        return (0.0,) * len(STATISTICS)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    top = Counter(ws).most_common(1)[0][1]
    upper, lower = count(UPPER), count(LOWER)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        float(n),
        sum(map(len, ws)) / n,
        float(max(map(len, ws))),
        len(set(ws)) / n,
        len(set(zip(ws, ws[1:]))) / max(n - 1, 1),
        top / n,
        sum(map(bytes.__eq__, ws, ws[1:])) / n,
        upper / max(upper + lower, 1),
        count(DIGITS) / size,
        count(SYMBOLS) / size,
        raw.count(b"|") / n,
        raw.count(b"!") / n,
        raw.count(b".") / n,
        raw.count(b",") / n,
        n / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        len(raw.translate(None, bytes(range(128)))) / size,
        sum(w[:1] in b"!#*$%&|" or w[-1:] in b"!#*$%&|" for w in ws) / n,
    )


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id and STATISTICS."""

    def run(batches):
        for batch in batches:
            rows = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(STATISTICS)))], names=["doc_id", *STATISTICS])

    return docs.mapInArrow(run, ", ".join(["doc_id long", *(f"{k} double" for k in STATISTICS)]))


def grown(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], depth: int, least: int) -> list[tuple]:
    """The paths of one regression tree: tuples of (feature, True for above, cut)."""
    paths: list[tuple] = []

    def split(at: np.ndarray, path: tuple) -> None:
        if path:
            paths.append(path)
        if len(path) == depth or len(at) < 2 * least:
            return
        r, best = residual[at], (1e-9, None, None)
        for f, values in enumerate(cuts):
            if not len(values):
                continue
            bins = np.searchsorted(values, x[at, f], side="left")  # rows of bin k are above all cuts before k
            n = np.cumsum(np.bincount(bins, minlength=len(values) + 1))[:-1]
            s = np.cumsum(np.bincount(bins, r, minlength=len(values) + 1))[:-1]
            ok = (n >= least) & (len(at) - n >= least)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(at) - n, 1) - r.sum() ** 2 / len(at), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, float(values[k]))
        if best[1] is None:
            return
        _, f, cut = best
        above = x[at, f] > cut
        split(at[~above], (*path, (f, False, cut)))
        split(at[above], (*path, (f, True, cut)))

    split(np.arange(len(x)), ())
    return paths


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, strength: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights of least logistic loss plus strength x their absolute sum, by accelerated proximal steps; the intercept is free."""
    n, m = z.shape
    w, b, v, c, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    step = 4.0 / max(float(np.linalg.norm(np.c_[z, np.ones(n)], 2) ** 2) / n, 1e-9)
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - step * (z.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * strength, 0)
        cut = c - step * float(g.mean())
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / u * (new - w), cut + (t - 1) / u * (cut - b)
        w, b, t = new, cut, u
    return w, b


def fitted(x: np.ndarray, y: np.ndarray, *, trees: int, depth: int, strength: float, seed: int, rounds: int = 400) -> tuple[list[tuple[tuple, float]], float]:
    """Rules with weights, and the intercept. The trees are grown on what the trees before them left over, each on half of the rows."""
    if not len(y) or y.min() == y.max():
        return [], 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    rng, score = np.random.default_rng(seed), np.zeros(len(y))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33), method="lower")) for f in range(x.shape[1])]
    rules: dict[tuple, None] = {}
    for _ in range(trees):
        at = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        residual = y - 1 / (1 + np.exp(-score))
        paths = grown(x[at], residual[at], cuts, depth, max(5, len(at) // 500))
        leaves = [p for p in paths if len(p) == depth or not any(q[: len(p)] == p and len(q) > len(p) for q in paths)]
        for p in leaves:
            hit = holds(p, x)
            if hit.any():
                q = 1 / (1 + np.exp(-score[hit]))
                score[hit] += 0.3 * (y[hit] - q).sum() / ((q * (1 - q)).sum() + 1.0)
        rules |= dict.fromkeys(paths)
    if not rules:
        return [], float(np.log(y.mean() / (1 - y.mean())))
    z = np.array([holds(r, x) for r in rules], float).T
    kept = np.unique(z, axis=1, return_index=True)[1]
    names = list(rules)
    w, b = lasso(z[:, kept], y, strength, rounds)
    return [(names[k], float(v)) for k, v in zip(kept, w) if abs(v) > 1e-6], b


def compiled(rules: list[tuple[tuple, float]], intercept: float) -> Column:
    """The ensemble's probability as one column expression over STATISTICS."""
    total = F.lit(float(intercept))
    for rule, weight in rules:
        when = F.lit(True)
        for f, above, cut in rule:
            column = F.col(STATISTICS[f])
            when = when & (column > cut if above else column <= cut)
        total = total + F.when(when, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def classify(docs: DataFrame, labels: DataFrame, *, train: Column | None = None, most_labelled: int = 20_000, trees: int = 30, depth: int = 3, strength: float = 0.001, seed: int = 23) -> DataFrame:
    """Each document's quality: doc_id, score, predicted.

    Statistics of all whole texts are taken once. The rules are fitted on at most `most_labelled` labelled rows for which `train`, over
    doc_id, holds, first by hash of the id; labels that are null are left out. Null, empty and blank texts have statistics 0 and
    are scored like others. Without labelled rows every score is 0.5. Repeated rows get equal scores, and one of an id's is learned from; an id's repeated labels all count.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "quality")
    slim = scratch.save(measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("y is not null and doc_id is not null")
    known = known.filter(train) if train is not None else known
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_labelled)
    # An id's repeated rows count once, so that no more rows are gathered than are labelled.
    own = slim.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*STATISTICS)).alias("x")).select("doc_id", "x.*")
    rows = own.join(F.broadcast(sample), "doc_id").select("doc_id", "y", *STATISTICS).collect()
    rows = sorted(tuple(r) for r in rows)
    data = np.array([r[1:] for r in rows], float).reshape(-1, len(STATISTICS) + 1)
    rules, intercept = fitted(data[:, 1:], data[:, 0], trees=trees, depth=depth, strength=strength, seed=seed)
    score = compiled(rules, intercept)
    return slim.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out() -> Column:
    return remainder("doc_id", 3) == 1

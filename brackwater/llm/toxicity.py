"""Toxicity by weak supervision: many voters, a label model of their accuracies and correlations, and a linear classifier on its posteriors."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, remainder, shipped, small_batches, text_of

shipped(__name__)

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
CACHE = 500_000

# General insults of four languages, a voter for each language.
INSULTS = {
    "en": "idiot idiots idiotic moron morons moronic stupid scum trash garbage loser losers pathetic worthless disgusting clown dumb fool imbecile jerk bastard bitch asshole freak coward pig filthy vermin retard scumbag",
    "de": "idiot idioten dumm dummkopf arschloch trottel depp scheisse abschaum versager widerlich erbärmlich wertlos schwachkopf mistkerl",
    "fr": "idiot idiote imbécile crétin connard connasse salaud salope abruti débile ordure pathétique dégoûtant minable raclure",
    "es": "idiota imbécil estúpido estúpida tonto basura escoria cabrón pendejo asqueroso patético inútil miserable payaso cretino",
}
# Patterns that speak for an attack.
PATTERNS = {
    "addressed": re.compile(r"\b(?:you|you're|du|ihr|tu|vous|eres)\s+(?:are|bist|seid|es|êtes|un|una|a|an|so|really|such)\s+\w+\s*!", re.I),
    "masked": re.compile(r"\b[a-z]+\*{2,}[a-z]*\b", re.I),
    "threat": re.compile(r"\b(?:kill|hurt|destroy|get rid of)\s+(?:you|yourself|them all)\b", re.I),
}
INSULT_SETS = [frozenset(v.split()) for v in INSULTS.values()]
FIXED = [*(f"insults-{k}" for k in INSULTS), *PATTERNS]


def word_features(word: str) -> list[str]:
    """A word by itself, marked at its end, and its beginnings."""
    return [f"{word}$", *(word[:k] for k in PREFIXES if len(word) > k)]


def text_features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in word_features(w)}


def fixed_votes(text: str, words: set[str] | None = None) -> list[int]:
    words = set(WORD.findall(text.lower())) if words is None else words
    return [*(int(not words.isdisjoint(v)) for v in INSULT_SETS), *(int(bool(p.search(text))) for p in PATTERNS.values())]


def _counted(docs: DataFrame, wanted: frozenset | None) -> DataFrame:
    """docs(text): of each feature, or each wanted one, the number of texts that have it."""

    def run(batches):
        counts: dict[str, int] = defaultdict(int)
        for batch in batches:
            for t in batch.column(0):
                for f in text_features(t.as_py()) if wanted is None else text_features(t.as_py()) & wanted:
                    counts[f] += 1
            if len(counts) >= CACHE:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["f", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["f", "n"])

    return docs.mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def surprise(k: int, of: int, n: int, total: int) -> float:
    """Log-likelihood ratio of k among `of` texts against n among total, 0 unless k is the larger share."""
    a, b, c, d = k, n - k, of - k, total - of - (n - k)
    if a / max(of, 1) <= b / max(total - of, 1):
        return 0.0
    term = lambda x, e: x * math.log(x / e) if x else 0.0
    return 2 * sum(term(x, r * s / total) for x, r, s in ((a, of, n), (b, total - of, n), (c, of, total - n), (d, total - of, total - n)))


def lexicon(toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int, *, least_texts: int, least_surprise: float, most_features: int) -> dict[str, float]:
    """Features that toxic texts have far more often than chance would let clean ones lack them, with how surprising each is."""
    # Of labelled rows, a bounded number: so are their features.
    seen = {r["f"]: r["n"] for r in _counted(toxic, None).filter(F.col("n") >= least_texts).toLocalIterator()}
    other = {r["f"]: r["n"] for r in _counted(clean, frozenset(seen)).collect()} if seen else {}
    scored = {f: surprise(k, n_toxic, k + other.get(f, 0), n_toxic + n_clean) for f, k in seen.items() if k >= 10 * other.get(f, 0)}
    best = sorted(((s, f) for f, s in scored.items() if s >= least_surprise), reverse=True)[:most_features]
    return {f: s for s, f in best}


def voters(features: dict[str, float]) -> dict[str, int]:
    """Each feature's voter: features that begin alike are one lexicon."""
    roots = sorted({f[: PREFIXES[0]] for f in features})
    return {f: len(FIXED) + roots.index(f[: PREFIXES[0]]) for f in features}


class Votes:
    """Patterns of votes in a batch, and how often each occurs: rows of zeros and ones."""

    def __init__(self, batch, of: np.ndarray, n_voters: int):
        hits, fixed = batch.column("hits").to_pylist(), batch.column("votes").to_pylist()
        self.times = batch.column("n").to_numpy().astype(float)
        self.matrix = np.zeros((len(hits), n_voters))
        for k, (h, f) in enumerate(zip(hits, fixed)):
            self.matrix[k, : len(f)] = f
            self.matrix[k, of[h]] = 1
        self.hits = hits


def posterior(votes: np.ndarray, model: tuple | None) -> np.ndarray:
    """The probability of being toxic, by the label model; before there is one, by how many voters say so."""
    if model is None:
        return np.where(votes.sum(1) > 0, 1 - 0.5 ** np.minimum(votes.sum(1) + 1, 6), 0.001)
    prior, hit, false, weight, *reach = model
    silent = 1 - votes
    if reach:  # silence counts of voters that are heard beside one that speaks here, and of all where none does
        silent = silent * ((votes @ reach[0] > 0) | (votes.sum(1) == 0)[:, None])
    odds = math.log(prior / (1 - prior)) + votes @ (weight * np.log(hit / false)) + silent @ (weight * np.log((1 - hit) / (1 - false)))
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def told(votes: np.ndarray, times: np.ndarray, model: tuple | None) -> list[np.ndarray]:
    """What a round of expectation maximisation needs of some patterns: sums over texts, toxic and clean, of votes and of pairs of votes."""
    toxic = times * posterior(votes, model)
    return [np.array([times.sum(), toxic.sum()]), toxic @ votes, (times - toxic) @ votes, (votes * toxic[:, None]).T @ votes, (votes * (times - toxic)[:, None]).T @ votes]


def labelled(rows: list[tuple], y: np.ndarray, of: np.ndarray, n_voters: int, step: int = 1000) -> list[np.ndarray]:
    """The sums of `told` over labelled rows of hits and votes, with labels for posteriors."""
    total = []
    for k in range(0, len(rows), step):
        t, v = y[k : k + step], np.zeros((len(rows[k : k + step]), n_voters))
        for own, (hits, fixed) in zip(v, rows[k : k + step]):
            own[: len(fixed)] = fixed
            own[of[hits]] = 1
        part = [np.array([len(t), t.sum()]), t @ v, (1 - t) @ v, (v * t[:, None]).T @ v, (v * (1 - t)[:, None]).T @ v]
        total = [a + b for a, b in zip(total, part)] if total else part
    return total


def next_model(sums: list[np.ndarray], known: list[np.ndarray] | None = None) -> tuple:
    """The prior, how often each voter fires on toxic and on clean texts, and its weight.

    Voters whose votes go together beyond what the posterior explains share their weight: the correlation is that of what is left of two votes inside the classes.
    With known, such sums over labelled texts of both classes, a class counts half by what the posteriors say and half by its labels, whichever has more texts; and the voters
    that are heard beside each come last: those that fire at least half as often beside it as among all toxic labelled texts. Voters of one language aren't heard beside another's.
    """
    (n, toxic), one, zero, ones, zeros = sums
    reach = []
    if known is not None:
        (m, y), *told_by_labels = known
        beside, often = told_by_labels[2] / np.maximum(told_by_labels[0], 1)[:, None], told_by_labels[0] / y
        reach = [(beside >= 0.5 * often).astype(float)]
        size = (toxic + n * y / m) / 2
        half = lambda a, b, by_votes, by_labels, texts: (a / max(by_votes, 1e-9) + b / by_labels) / 2 * texts
        one, ones = (half(a, b, toxic, y, size) for a, b in zip((one, ones), told_by_labels[::2]))
        zero, zeros = (half(a, b, n - toxic, m - y, n - size) for a, b in zip((zero, zeros), told_by_labels[1::2]))
        toxic = size
    prior = min(max((toxic + 1) / (n + 2), 1e-4), 0.5)
    hit, false = np.clip((one + 0.5) / (toxic + 1), 1e-3, 0.999), np.clip((zero + 0.05) / (n - toxic + 1), 1e-6, 0.5)
    left = ones - toxic * np.outer(hit, hit) + zeros - (n - toxic) * np.outer(false, false)
    spread = np.sqrt(np.maximum(toxic * hit * (1 - hit) + (n - toxic) * false * (1 - false), 1e-9))
    tied = np.clip(left / np.outer(spread, spread), 0, 1)
    np.fill_diagonal(tied, 0)
    return prior, hit, np.minimum(false, hit * 0.9), 1 / (1 + np.where(tied > 0.3, tied, 0).sum(0)), *reach


def label_model(patterns: DataFrame, of: np.ndarray, n_voters: int, rounds: int = 8, known: list[np.ndarray] | None = None) -> tuple | None:
    """Expectation maximisation over patterns(hits, votes, n) of all training texts, labelled or not. Each round is one sum over the patterns. No label is looked at but those of known, which is where it starts from and what it is held to."""
    model = None if known is None else next_model(known, known)
    for _ in range(rounds):
        def run(batches, model=model):
            total = None
            for batch in batches:
                if batch.num_rows:
                    v = Votes(batch, of, n_voters)
                    part = told(v.matrix, v.times, model)
                    total = part if total is None else [a + b for a, b in zip(total, part)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in total]).tobytes()], pa.binary())], names=["sums"])

        got = [np.frombuffer(r["sums"]) for r in patterns.mapInArrow(run, "sums binary").collect()]
        if not got:
            return None
        flat, shapes = sum(got), [(2,), (n_voters,), (n_voters,), (n_voters, n_voters), (n_voters, n_voters)]
        cuts = np.cumsum([0, *(math.prod(x) for x in shapes)])
        model = next_model([flat[a:b].reshape(x) for a, b, x in zip(cuts, cuts[1:], shapes)], known)
    return model


def linear(patterns: DataFrame, of: np.ndarray, n_voters: int, model: tuple, n_features: int, *, rounds: int = 25, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on the posterior labels of all patterns, over presence features and the fixed voters: each round is one sum of gradients."""
    size = n_features + len(FIXED) + 1
    w, sums = np.r_[np.zeros(n_features), np.zeros(len(FIXED)), -3.0], np.full(size, 1e-8)
    for _ in range(rounds):
        def run(batches, w=w):
            total = np.zeros(size + 1)
            for batch in batches:
                if batch.num_rows:
                    v = Votes(batch, of, n_voters)
                    target = posterior(v.matrix, model)
                    sizes = np.array([len(h) for h in v.hits])
                    rows, cols = np.repeat(np.arange(len(v.hits)), sizes), np.array([c for h in v.hits for c in h], int)
                    scale = 1 / np.sqrt(np.maximum(sizes, 1))[rows]
                    fixed = v.matrix[:, : len(FIXED)]
                    z = fixed @ w[n_features:-1] + w[-1] + np.bincount(rows, scale * w[cols], len(v.hits))
                    g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * v.times
                    total += np.r_[np.bincount(cols, scale * g[rows], n_features) if n_features else np.zeros(0), fixed.T @ g, g.sum(), v.times.sum()]
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        got = sum((np.frombuffer(r["sums"]) for r in patterns.mapInArrow(run, "sums binary").collect()), np.zeros(size + 1))
        g = got[:-1] / max(got[-1], 1) + np.r_[decay * w[:-1] / size, 0.0]
        sums += g * g
        w = w - 1.0 * g / np.sqrt(sums)
    return w[:n_features], w[n_features:-1], float(w[-1])


def _observed(docs: DataFrame, features: dict[str, int], carried: str) -> DataFrame:
    """docs(carried columns, text last) with the lexicon features that the text has and the fixed voters' votes."""
    names = [c.split()[0] for c in carried.split(", ")]

    def run(batches):
        of: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            hits, votes = [], []
            for t in batch.column(len(names)):
                text = t.as_py()
                words = set(WORD.findall(text.lower()))
                found: set[int] = set()
                for w in words:
                    ks = of.get(w)
                    if ks is None:
                        if len(of) >= CACHE:
                            of.clear()
                        ks = of[w] = tuple(features[f] for f in word_features(w) if f in features)
                    if ks:
                        found.update(ks)
                hits.append(sorted(found))
                votes.append(fixed_votes(text, words))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(hits, pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int32()))], names=[*names, "hits", "votes"])

    return docs.mapInArrow(run, f"{carried}, hits array<int>, votes array<int>")


def classify(docs: DataFrame, labels: DataFrame, *, train: Column | None = None, most_labelled: int = 20_000, least_texts: int = 4, least_surprise: float = 28.0, most_features: int = 5000) -> DataFrame:
    """Each document's toxicity: doc_id, score, predicted.

    From at most `most_labelled` labelled rows for which `train`, over doc_id, holds, first by hash of the id, features (words and
    their beginnings) are chosen that toxic texts have and clean ones lack, the `most_features` most surprising; those that begin alike are one lexicon voter. General
    insults and patterns are further voters. Each whole text's votes are taken once. From the patterns of votes of all training texts, labelled or not, the label model estimates
    how often each voter fires on toxic and on clean texts and which voters go together, held half to what the same labelled rows say, so that a language of few toxic texts isn't
    taken for clean; and a linear classifier is trained on its posteriors of all these texts. The labels then set the point of 0.5.

    Null, empty and blank texts have no feature and get the intercept's score. Without labelled rows only the fixed voters speak. Labels that
    are null are left out, and an id's repeated labels count as toxic if one does; repeated rows get equal scores. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "toxicity")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("y is not null and doc_id is not null")
    known = (known.filter(train) if train is not None else known).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = scratch.save(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled), "known")
    # An id's repeated rows count once: their number is bounded only so.
    rows = scratch.save(slim.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "labelled")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    chosen = lexicon(rows.filter("y = 1").select("text"), rows.filter("y = 0").select("text"), n_toxic, n_clean, least_texts=least_texts, least_surprise=least_surprise, most_features=most_features) if n_toxic and n_clean else {}
    index = {f: k for k, f in enumerate(sorted(chosen))}
    lexicons = voters(chosen)
    n_voters = len(FIXED) + len({v for v in lexicons.values()})
    of = np.array([lexicons[f] for f in sorted(chosen)], int)
    seen = scratch.save(_observed(slim, index, "doc_id long"), "observed")
    learned = seen if train is None else seen.filter(train)
    patterns = scratch.save(learned.groupBy("hits", "votes").agg(F.count(F.lit(1)).alias("n")), "patterns")
    # Of an id with several texts the one whose votes come first, whichever task has it.
    own = seen.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("hits", "votes")).alias("m"))
    got = sorted((r["doc_id"], r["y"], r["hits"], r["votes"]) for r in own.select("doc_id", "y", "m.hits", "m.votes").collect())
    y = np.array([r[1] for r in got], float)
    both = len(y) > 0 and y.min() != y.max()
    model = label_model(patterns, of, n_voters, known=labelled([(r[2], r[3]) for r in got], y, of, n_voters) if both else None)
    weights, dense, intercept, shift = np.zeros(len(index)), np.full(len(FIXED), 3.0), -3.0, 0.0
    if model is not None:
        weights, dense, intercept = linear(patterns, of, n_voters, model, len(index))
        shift = -_border(np.array([scored(r[2], r[3], weights, dense, intercept) for r in got]), y) if both else 0.0
    return _scored(seen, weights.tolist(), [float(u) for u in dense], intercept + shift)


def scored(hits, fixed, weights, dense, intercept) -> float:
    """Log-odds; a text's features share their weight by the root of their number, as in training."""
    return float(intercept + (sum(weights[h] for h in hits) / math.sqrt(len(hits)) if len(hits) else 0.0) + sum(u * v for u, v in zip(dense, fixed)))


def _border(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds at which most labelled rows are right, both labels counting alike; midway to the next row."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    gain = np.cumsum((y == 0) / max((y == 0).sum(), 1) - (y == 1) / max((y == 1).sum(), 1))
    ends = np.r_[z[1:] > z[:-1], False]
    if not ends.any():
        return 0.0
    k = int(np.argmax(np.where(ends, gain, -np.inf)))
    return float((z[k] + z[k + 1]) / 2)


def _scored(seen: DataFrame, weights: list[float], dense: list[float], intercept: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            z = [scored(h, v, weights, dense, intercept) for h, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1 / (1 + math.exp(-max(min(x, 700.0), -700.0))) for x in z], pa.float64())], names=["doc_id", "score"])

    return seen.select("doc_id", "hits", "votes").mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out() -> Column:
    return remainder("doc_id", 5) == 0

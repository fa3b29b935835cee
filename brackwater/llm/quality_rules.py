"""Quality rules: counted signals and a hashed n-gram log-likelihood ratio between trusted and raw text, in DataFrame operations only."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, let, text_of, unused, words

SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 5
#: Weights are whole thousandths of a natural logarithm, so that sums don't depend on their order.
SCALE = 1000


def repeated_words(ws: Column) -> Column:
    """Words in windows of five that are found twice or more in the text, the first included.

    Windows are told apart by 64-bit hashes. Most texts repeat none; only the others are sorted.
    """
    n = F.size(ws)
    hashes = F.transform(F.slice(ws, 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, WINDOW)]))

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    def found_again(s: Column) -> Column:
        again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return let(F.array_sort(F.transform(again, lambda x: x["p"])), covered)

    def sort(h: Column) -> Column:
        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), found_again)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(sort(h))).cast("long")


def signals(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text that isn't null."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.aggregate(ws, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            repeated_words(ws).alias("n_repeat_words"),
        ),
    )


def failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def grams(ws: Column, buckets: int) -> Column:
    """Buckets of the text's words and pairs of neighbouring words, as they are written."""
    one = F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(w, F.get(ws, i)), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def labelled_ids(labels: DataFrame, part: int, id_column: str = "doc_id") -> DataFrame:
    """Ids of all rows labelled good, of one half of the ids by hash. Half 0 is trusted, half 1 sets the threshold."""
    good = labels.filter(F.col("quality") == 1).select(F.col(id_column).cast("long").alias("_trusted")).filter(F.col("_trusted").isNotNull()).distinct()
    return good.filter(F.pmod(F.xxhash64("_trusted", F.lit(29)), F.lit(2)) == part)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("_text"))


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs(_id, _text) with `_in`: whether its id is among the ids. Ids go to the texts in groups of 1,024 neighbours, which are few rows however many ids there are; only very scattered ones are joined by a shuffle."""
    place = lambda c: F.col(c).bitwiseAND(F.lit(1023)).cast("short")
    groups = ids.groupBy(F.shiftright("_trusted", 10).alias("_group")).agg(F.collect_list(place("_trusted")).alias("_places"))
    met = docs.join(bounded_broadcast(groups, groups.count()), F.shiftright("_id", 10) == F.col("_group"), "left")
    return met.select("_id", "_text", F.coalesce(F.array_contains("_places", place("_id")), F.lit(False)).alias("_in"))


def ratio_weights(docs: DataFrame, labels: DataFrame, *, buckets: int, smoothing: float) -> list[int]:
    """For each bucket log(share in trusted / share in raw) in thousandths. Raw counts cover all documents, every n-gram of them."""
    rows = _marked(_texts(docs), labelled_ids(labels, 0))
    each = rows.select(F.col("_in").cast("long").alias("t"), F.explode(let(words(F.col("_text")), lambda ws: grams(ws, buckets))).alias("b"))
    counts = {r["b"]: (r["raw"], r["good"]) for r in each.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("good")).collect()}
    raw, good = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not good:
        return [0] * buckets
    share = lambda n, of: math.log((n + smoothing) / (of + smoothing * buckets))
    return [round(SCALE * (share(g, good) - share(r, raw))) for r, g in (counts.get(b, (0, 0)) for b in range(buckets))]


def summed_ratio(text: Column, table: Column, buckets: int) -> Column:
    """struct(sum, n): the sum of the weights of a text's n-grams, in whole thousandths, and their number."""
    total = lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    return let(words(text), lambda ws: let(grams(ws, buckets), lambda g: F.struct(total(g).alias("sum"), F.size(g).alias("n"))))


def threshold(docs: DataFrame, labels: DataFrame, table: Column, *, buckets: int, doubt: float, keep: float, least: int = 10, default: float = -0.03) -> float:
    """The ratio, in thousandths rounded down, that a share `keep` of the other half of the good rows reaches, with the doubt that their length leaves; `default` with fewer than `least` of them.

    Rounding keeps the order, so rows are counted by their thousandth, of which there are few, and the place is looked for among the counts: no row is left out, none is sent to the driver.
    """
    rows = _marked(_texts(docs), labelled_ids(labels, 1)).filter("_in")
    found = rows.select("_id", summed_ratio(F.col("_text"), table, buckets).alias("r")).groupBy("_id").agg(F.min("r").alias("r")).select("r.*").filter("n > 0")
    reached = (F.col("sum") / F.lit(float(SCALE)) + F.lit(doubt) * F.sqrt("n")) / F.col("n")
    counts = sorted((r["at"], r["count"]) for r in found.groupBy(F.floor(F.lit(SCALE) * reached).alias("at")).count().collect())
    total = sum(n for _, n in counts)
    if total < least:
        return default
    place = int((1 - keep) * total)
    return next(at for (at, _), upto in zip(counts, accumulate(n for _, n in counts)) if upto > place) / SCALE


def apply_rules(docs: DataFrame, labels: DataFrame, *, buckets: int = 16_384, smoothing: float = 0.5, least_ratio: float | None = None, keep: float = 0.99, doubt: float = 0.5, column: str = "rules") -> DataFrame:
    """docs with `column`, a struct of signals and verdict.

    ratio is the sum of the n-grams' log-likelihood ratios over their number. A document is kept if it isn't base_failed and
    ratio >= least_ratio - doubt / sqrt(number of n-grams): few n-grams are little evidence. Trusted are half of the rows labelled good, by a hash of their ids;
    least_ratio, unless it is given, is what a share `keep` of the other half reaches. No labelled row is left out. Counts are whole numbers and weights whole
    thousandths, so every run gives the same verdicts.

    Null and empty texts have no words, so they are base_failed. Without a trusted document all ratios are 0. Repeated rows are judged alike.
    Other columns pass through; one of that name is replaced.
    """
    weights = ratio_weights(docs, labels, buckets=buckets, smoothing=smoothing)
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    if least_ratio is None:
        least_ratio = threshold(docs, labels, table, buckets=buckets, doubt=doubt, keep=keep)
    out = docs.withColumn(column, F.struct(signals(text_of()).alias("s"), summed_ratio(text_of(), table, buckets).alias("r")))
    s, r = F.col(f"{column}.s"), F.col(f"{column}.r")
    enough = r["sum"] >= SCALE * (F.lit(least_ratio) * r["n"] - F.lit(doubt) * F.sqrt(r["n"]))
    fields = [s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    mean = F.when(r["n"] > 0, r["sum"] / (SCALE * r["n"])).otherwise(F.lit(0.0))
    return out.withColumn(column, F.struct(*fields, failed(s).alias("base_failed"), (~failed(s) & enough).alias("kept"), mean.alias("ratio")))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with docs' columns."""
    own = unused(docs, "rules")
    return apply_rules(docs, labels, column=own, **options).filter(f"{own}.kept").select(*docs.columns)

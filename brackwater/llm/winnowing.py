"""Document fingerprints by winnowing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, text_of

#: Code points in a gram; grams in a window. Texts that share GRAM + WINDOW - 1 code points in a row share a fingerprint.
GRAM, WINDOW = 8, 16
LOW = 31


def characters(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def value(h: Column, at: Column) -> Column:
    """A 32-bit hash and its position in one number whose order is by hash, of equal ones the rightmost first."""
    return F.shiftleft(h.cast("long") + F.lit(1 << 31), LOW).bitwiseOR(F.lit((1 << LOW) - 1) - at)


def placed(hashes: Column, shift: Column | None = None) -> Column:
    return F.transform(hashes, lambda h, i: value(h, i if shift is None else i + shift))


def grams(chars: Column, shift: Column | None = None) -> Column:
    """Values of all runs of GRAM code points, hashed from runs of 4 in one pass each; of a shorter text, one of the whole."""
    n = F.size(chars)
    four = F.transform(F.slice(chars, 1, F.greatest(n - 3, F.lit(0))), lambda c, i: F.xxhash64(c, F.get(chars, i + 1), F.get(chars, i + 2), F.get(chars, i + 3)))
    eight = let(four, lambda h: F.transform(F.slice(h, 1, F.greatest(n - (GRAM - 1), F.lit(0))), lambda x, i: value(F.hash(x, F.get(h, i + 4)), i if shift is None else i + shift)))
    whole = F.array(value(F.hash(F.array_join(chars, "")), F.lit(0) if shift is None else shift))
    return F.when(n >= GRAM, eight).when(n > 0, whole).otherwise(F.array().cast("array<long>"))


def selected(values: Column) -> Column:
    """The least value of each window of WINDOW grams, each once, by first window; of fewer grams, the least of all."""
    n = F.size(values)

    def least(v: Column, step: int, count: Column) -> Column:
        return F.transform(F.slice(v, 1, F.greatest(count, F.lit(1))), lambda x, i: F.least(x, F.get(v, i + step), F.get(v, i + 2 * step), F.get(v, i + 3 * step)))

    windows = let(least(values, 1, n - 3), lambda four: least(four, 4, n - (WINDOW - 1)))
    return F.when(n >= WINDOW, F.array_distinct(windows)).when(n > 0, F.array(F.array_min(values))).otherwise(F.array().cast("array<long>"))


def hash_of(value: Column) -> Column:
    return F.shiftrightunsigned(value, LOW)


def position_of(value: Column) -> Column:
    return F.lit((1 << LOW) - 1) - value.bitwiseAND(F.lit((1 << LOW) - 1))


def fingerprint(text: Column) -> Column:
    """array(struct(hash, position)) of a text that isn't null; empty for an empty text."""
    return F.transform(found(text), lambda v: F.struct(hash_of(v).alias("hash"), position_of(v).alias("position")))


def likeness(a: Column, b: Column) -> Column:
    """Shared over all distinct hashes of two fingerprints of placed hashes; 1 if both are empty."""
    one, two = (F.array_distinct(F.transform(x, hash_of)) for x in (a, b))
    both = lambda p, q: let(F.size(F.array_intersect(p, q)), lambda n: F.when(F.size(p) + F.size(q) == 0, F.lit(1.0)).otherwise(n / (F.size(p) + F.size(q) - n)))
    return let(one, lambda p: let(two, lambda q: both(p, q)))


def digest(values: Column) -> Column:
    """A fingerprint in short: SHA-256 of its hashes with their positions."""
    return F.sha2(F.array_join(values.cast("array<string>"), ","), 256)


def dealt_by_range(docs: DataFrame, *, per_partition: int = 4, most: int = 65_536) -> DataFrame:
    """docs(doc_id, ...) with `_at` and `_kind`, dealt so that the rows of kind 0 of one `_at` are a range of descending ids.

    Ids are cut at approximate quantiles. Each range also gets the head of the range after it, as kind 1; the last gets that of the first.
    Rows move once and no task gets more than a few ranges. Null ids are the last ones.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(most, per_partition * parts)
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 20 * ranges).alias("c")).first()["c"] or []))
    edges = F.split(F.lit(",".join(map(str, cuts)) or "0"), ",").cast("array<long>")
    at = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - _below(edges, len(cuts)))
    rows = docs.withColumn("_range", at.cast("int"))
    heads = sorted((r["_range"], r["_id"]) for r in rows.groupBy("_range").agg(F.max("doc_id").alias("_id")).collect())  # a row for each range
    before = {heads[k][0]: heads[k - 1][0] for k in range(len(heads))}
    tops = dict(heads)
    back = F.get(F.split(F.lit(",".join(str(before.get(k, 0)) for k in range(len(cuts) + 1))), ","), F.col("_range")).cast("int")
    top = F.get(F.split(F.lit(",".join(str(tops.get(k)) for k in range(len(cuts) + 1))), ","), F.col("_range")).try_cast("long")
    to = F.when(F.col("doc_id").eqNullSafe(top), F.array(F.col("_range"), back)).otherwise(F.array(F.col("_range")))
    dealt = rows.select(*docs.columns, F.posexplode(to).alias("_kind", "_at"))
    return dealt.repartition(parts, "_at")


def _below(edges: Column, n: int) -> Column:
    """How many of n ascending edges are below doc_id, by halving."""
    def halve(step: int):
        return lambda a: F.when((a + step <= n) & (F.get(edges, a + (step - 1)) < F.col("doc_id")), a + step).otherwise(a)

    at = F.lit(0)
    for k in range(n.bit_length() - 1, -1, -1):
        at = let(at, halve(1 << k))
    return at


def found(text: Column, shift: Column | None = None) -> Column:
    return let(characters(text), lambda c: let(grams(c, shift), selected))


def found_after_edit(own: Column, edited: Column, same: Column) -> Column:
    """The fingerprint of a text that shares its first `same` code points with the text whose fingerprint own is.

    Windows inside the shared part choose as before; only the rest of the text is hashed. A value is chosen first by the window that
    takes it in, if it is the least there, and otherwise by the window that loses the value before it.
    """
    span = GRAM + WINDOW - 1
    last = same - span

    def kept(o: Column) -> Column:
        def first(v: Column, i: Column) -> Column:
            left = F.get(o, i - 1)
            return F.when(left.isNull(), F.lit(0).cast("long")).when(v < left, position_of(v) - (WINDOW - 1)).otherwise(position_of(left) + 1)

        return F.filter(o, lambda v, i: first(v, i) <= last)

    tail = F.substring(edited, F.greatest(last + 2, F.lit(1)), F.lit(2**31 - 1))
    rest = F.when((last >= 0) & (F.length(tail) < span), F.array().cast("array<long>")).otherwise(found(tail, F.greatest(last + 1, F.lit(0)).cast("long")))
    return F.array_distinct(F.concat(F.when(last >= 0, let(own, kept)).otherwise(F.array().cast("array<long>")), rest))


def neighbours(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each whole text, and of the text with its last third replaced by the start of the next document, with their likeness.

    The next document follows by descending id; after the last comes the first, so a single document follows itself. Null texts are empty;
    an empty text has an empty fingerprint, and two empty ones are alike (1). Rows with null ids come last; rows with one id are
    ordered by text, and equal rows follow each other. Other columns are ignored. Fingerprints are arrays of hashes with positions.
    """
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    rows = dealt_by_range(slim).withColumn("own", found(F.col("text")))
    after = F.lead(F.struct("text", "own")).over(Window.partitionBy("_at").orderBy("_kind", F.col("doc_id").desc_nulls_last(), "text"))
    rows = rows.withColumn("after", after).filter("_kind = 0")
    n = F.length("text")
    m = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - m), F.substring(F.col("after.text"), F.lit(1), m))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", (n - m).alias("_same"), F.col("after.own").alias("following"))
    return rows.withColumn("changed", found_after_edit(F.col("own"), F.col("edited"), F.col("_same"))).drop("_same")

"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded_broadcast, text_of, words

RADIX = 256
#: Like rows that are numbered together, about.
MANY = 20_000
#: What like rows share: they differ in nothing that the mix looks at.
KIND = ("source", "h", "doc_id", "size", "th")


def ranked(sources: DataFrame, column: str) -> DataFrame:
    """sources with `position`, counted from 0 by code point, null last.

    Rows are dealt by range, numbered inside each range, and shifted by the ranges before, so that no task sees all of them.
    """
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(column).asc_nulls_last()
    dealt = sources.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id())
    scratch = Scratch(spark, "ranked")
    dealt = scratch.save(dealt, "dealt")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return dealt.withColumn("_inside", inside).join(F.broadcast(shift), "_range").select(*sources.columns, (F.col("_inside") + F.col("_before")).alias("position"))


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """sources(weight, cap, ...) with `target`: weight x level, at most cap, the level such that the targets add up to total.

    Each round clamps every source above its cap and shares out again what they leave, as one aggregation that returns one row;
    it ends when no source is above. If all caps together are below total, every source gets its cap.
    """
    open_ = F.lit(True)
    level = None
    while True:
        row = sources.agg(F.sum(F.when(open_, F.col("weight"))).alias("w"), F.sum(F.when(~open_, F.col("cap"))).alias("c"), F.count(F.when(open_, 1)).alias("n")).first()
        if not row["n"] or not row["w"]:
            break
        new = (total - float(row["c"] or 0.0)) / float(row["w"])
        if level is not None and new <= level:
            break
        level = new
        still = F.col("cap") >= F.col("weight") * F.lit(level)
        if sources.filter(open_ & ~still).isEmpty():
            break
        open_ = still
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level)))


def _hash(doc_id, size, seed: int):
    """63 bits by which a source's documents are ordered."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), size, F.lit(seed)), 1)


def _alike(rows: DataFrame, kinds: DataFrame, count: int) -> DataFrame:
    """rows with what their kind, of_source, of_h, ..., says."""
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in KIND]
    return rows.join(bounded_broadcast(kinds, count), same[0] & same[1] & same[2] & same[3] & same[4])


def _shared(rows: DataFrame, kinds: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (KIND, row) at the borders with `one`: of what is left for their kind, each row takes all of its words until nothing is.

    Like rows are numbered exactly: dealt to parts by `row`, numbered in each, and shifted by the parts before, so that no task sees very many of them.
    """
    count = kinds.count()
    rows = _alike(rows, kinds, count).withColumn("part", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / MANY)))
    parts = rows.groupBy(*KIND, "part").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy(*KIND).orderBy("part")) - F.col("m")
    parts = scratch.save(parts.select(*[F.col(c).alias(f"in_{c}") for c in KIND], F.col("part").alias("in_part"), before.alias("before")).filter("before > 0"), "parts")
    here = F.col("part") == F.col("in_part")
    for c in KIND:
        here &= F.col(c).eqNullSafe(F.col(f"in_{c}"))
    inside = F.row_number().over(Window.partitionBy(*KIND, "part").orderBy("row")) - 1
    rows = rows.withColumn("inside", inside).join(bounded_broadcast(parts, parts.count()), here, "left")
    number = F.col("inside") + F.coalesce("before", F.lit(0))
    return rows.withColumn("one", F.greatest(F.lit(0), F.least(F.col("size"), F.col("all") - F.col("size") * number)))


def _rules(docs: DataFrame, scratch: Scratch, *, weights: tuple = (5, 2, 1), budget: float = 1.5, most_epochs: float = 2.0, seed: int = 7, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text"):
    """For each source what its documents take; the kinds of rows at the borders with what is left for each; all rows with their source's rule; the number of sources."""
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.size(words(text_of(text_column))).cast("long").alias("size"), F.xxhash64(text_of(text_column)).alias("th"))
    slim = scratch.save(slim.withColumn("h", _hash(F.col("doc_id"), F.col("size"), seed)).withColumn("row", F.monotonically_increasing_id()), "sizes")
    sources = ranked(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    sources = scratch.save(sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most_epochs))).alias("cap")), "sources")
    found = sources.agg(F.sum("source_size").alias("words"), F.count(F.lit(1)).alias("n")).first()
    filled = water_fill(sources, budget * float(found["words"] or 0))
    rounded = F.least(F.round("target").cast("long"), F.floor(F.col("source_size") * F.lit(float(most_epochs))).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(rounded / F.col("source_size"))).otherwise(0).cast("long")
    plan = scratch.save(filled.select("source", "source_size", "target", whole.alias("whole"), (rounded - whole * F.col("source_size")).alias("extra")), "plan")

    def digit(level: int):
        return F.shiftright("h", 63 - 8 * (level + 1)).bitwiseAND(F.lit(RADIX - 1)) if level else F.shiftright("h", 55)

    def border(rows: DataFrame, before: DataFrame, level: int) -> DataFrame:
        """before(source, extra): of each source, the digit at which the summed sizes pass extra, and what is left of extra there."""
        sums = rows.groupBy("source", digit(level).alias(f"d{level}")).agg(F.sum("size").alias("n"))
        sums = sums.join(bounded_broadcast(before.withColumnRenamed("source", "of"), found["n"]), F.col("source").eqNullSafe(F.col("of")))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy(f"d{level}").rowsBetween(Window.unboundedPreceding, 0))
        passed = sums.withColumn("upto", upto).filter((F.col("upto") > F.col("extra")) & (F.col("upto") - F.col("n") <= F.col("extra")))
        return scratch.save(passed.select("source", (F.col("extra") - F.col("upto") + F.col("n")).alias("extra"), F.col(f"d{level}").cast("long").alias(f"d{level}")), f"border{level}")

    at = border(slim, plan.select("source", "extra"), 0)
    second = slim.join(bounded_broadcast(at.select(F.col("source").alias("s"), "d0"), found["n"]), F.col("source").eqNullSafe(F.col("s")) & (digit(0) == F.col("d0")), "left_semi")
    below = border(second, at.select("source", "extra"), 1)
    edge = at.select(F.col("source").alias("s0"), "d0").join(below.select(F.col("source").alias("s1"), "d1", F.col("extra").alias("left_over")), F.col("s0").eqNullSafe(F.col("s1")), "left").select("s0", "d0", "d1", "left_over")
    rules = plan.join(edge, F.col("source").eqNullSafe(F.col("s0")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", "extra", "d0", "d1", "left_over")
    rules = scratch.save(rules, "rules")
    told = slim.join(bounded_broadcast(rules, found["n"]), F.col("source").eqNullSafe(F.col("s")))
    prefix, limit = F.shiftright("h", 47), F.col("d0") * RADIX + F.col("d1")
    # Only about one in 65,536 kinds of rows is at its source's border: they share what is left by kinds first, and then inside each.
    kinds = told.filter(prefix == limit).groupBy(*KIND).agg(F.count(F.lit(1)).alias("n"), F.first("left_over").alias("left"))
    upto = F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("source").orderBy("h", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, 0))
    all_ = F.greatest(F.lit(0), F.least(F.col("n") * F.col("size"), F.col("left") - (F.col("upto") - F.col("n") * F.col("size"))))
    kinds = scratch.save(kinds.withColumn("upto", upto).select(*[F.col(c).alias(f"of_{c}") for c in KIND], "n", all_.alias("all")), "kinds")
    return rules, kinds, told, found["n"]


def mix(docs: DataFrame, *, scratch: Scratch | None = None, **options) -> DataFrame:
    """How many words of each document a mix of all sources takes.

    A document's size is its number of words. Sources in code-point order weigh `weights`, repeating; together they get budget x all words.
    Every source is clamped at most_epochs x its words and the excess is reshared by weight. A source then takes each document floor(e) times,
    e being target / words, and once more those documents whose seeded hash comes first, until the target is met; the document at
    the border gives a fractional repetition, so a source's taken words are its target rounded.

    Null and empty texts have size 0 and take 0. A null source is a source of its own, last in order. Repeated rows (also of one id) are
    separate documents; rows alike in id and size share their hash, and those at the border are told apart by their texts' hash and then by an arbitrary but complete
    order, which cannot change the rows that come out. Other columns are ignored. An empty table gives no rows.
    Returns doc_id, size, source_size (long), target (double, its source's), taken (long).
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    _, kinds, told, _ = _rules(docs, scratch, **options)
    prefix, limit = F.shiftright("h", 47), F.col("d0") * RADIX + F.col("d1")
    base = ["doc_id", "size", "source_size", "target"]
    taken = lambda part: (F.col("size") * F.col("whole") + part).cast("long").alias("taken")
    clear = told.filter(F.col("d1").isNull() | (prefix != limit)).select(*base, taken(F.when(prefix < limit, F.col("size")).otherwise(0)))
    return clear.unionByName(_shared(told.filter(prefix == limit), kinds, scratch).select(*base, taken(F.col("one"))))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with docs' columns: a row for each whole repetition, and for a fractional one the first words of the text.

    Rows are told apart by id, size and their text's hash; of rows alike in all three and at a source's border the first in an arbitrary order are taken.
    Rows with null text or no word are not in the mix: they hold no word to take. Texts stay where they are read: only the
    rules, a row for each source, are sent to them; rows at the borders, of about one in 65,536 kinds, are written to be numbered.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    rules, kinds, _, n = _rules(docs, scratch, **options)
    size = F.size(words(text_of())).cast("long")
    # The whole row is one column, so that its names meet no others.
    row = lambda c: F.col(f"own.{c}")
    own = docs.select(F.struct(*docs.columns).alias("own"), size.alias("size"), F.xxhash64(text_of()).alias("th"))
    own = own.withColumn("doc_id", row("doc_id").cast("long")).withColumn("source", row("source").cast("string")).withColumn("h", _hash(F.col("doc_id"), F.col("size"), options.get("seed", 7)))
    rules = rules.select(F.col("s"), "whole", (F.col("d0") * RADIX + F.col("d1")).alias("limit"))
    own = own.join(bounded_broadcast(rules, n), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    prefix = F.shiftright("h", 47)
    clear = own.filter(F.col("limit").isNull() | (prefix != F.col("limit"))).withColumn("one", F.when(prefix < F.col("limit"), F.col("size")).otherwise(0))
    border = scratch.save(own.filter(prefix == F.col("limit")).withColumn("row", F.monotonically_increasing_id()), "border")
    here = ["own", "size", "whole", "one"]
    own = clear.select(*here).unionByName(_shared(border, kinds, scratch).select(*here)).withColumn("taken", F.col("size") * F.col("whole") + F.col("one")).filter("size > 0 and taken > 0")
    own = own.withColumn("times", F.floor(F.col("taken") / F.col("size")).cast("int")).withColumn("part", (F.col("taken") % F.col("size")).cast("int"))
    own = own.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times") + (F.col("part") > 0).cast("int"))))
    partial = F.col("copy") > F.col("times")
    text = F.when(partial, F.array_join(F.slice(words(row("text")), 1, F.greatest(F.col("part"), F.lit(1))), " ")).otherwise(row("text"))
    put = {"text": text}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(partial, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(row("n_chars"))
    return own.select(*[put.get(c, row(c)).alias(c) for c in docs.columns])

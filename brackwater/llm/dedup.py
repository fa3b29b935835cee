"""Near-duplicate documents: MinHash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded_broadcast, shipped, small_batches, text_of, unused

shipped(__name__)

#: Word hashes that a worker keeps at most.
CACHE = 100_000
#: Shingles whose hashes are computed at once, about.
BLOCK = 60_000
#: An item is rare if at most so many of the sets under comparison hold it.
RARE = 24


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, hashes: _Hashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `size` words; of fewer words, one of them all; none without words.

    Lower case is for A-Z alone, and words are split at ASCII white space: what bytes.lower and bytes.split do.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < size:
        h = np.concatenate([h, np.zeros(size - len(h), np.uint64)])
    n, out = len(h) - size + 1, np.full(len(h) - size + 1, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(size):
        out = mixed(out ^ h[k : n + k]) + np.uint64(k + 1)
    return np.unique(out)


def _family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, np.uint64)


def signatures(sets: list[np.ndarray], tables: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set 2 x tables numbers, each joined from `rows` minimum hashes, and a sketch: one bit of each minimum hash, 64 in a number."""
    odd, add = _family(2 * tables * rows, seed)
    x, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out, sketch = np.zeros((len(sets), 2 * tables), np.uint64), np.zeros((len(sets), -(-2 * tables * rows // 64)), np.uint64)
    for k in range(2 * tables * rows):
        least = np.minimum.reduceat((x ^ add[k]) * odd[k], starts)
        out[:, k // rows] = mixed(out[:, k // rows] ^ least) + np.uint64(1)
        sketch[:, k // 64] |= (mixed(least) & np.uint64(1)) << np.uint64(k % 64)
    return out, sketch


def _signed(docs: DataFrame, size: int, tables: int, rows: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (two numbers), the two collections of table parts, and the sketch."""
    width = -(-2 * tables * rows // 64)

    def run(batches):
        hashes, kind = _Hashes(), pa.list_(pa.int64())
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sets = [shingles(t.as_py(), hashes, size) for t in texts]
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
            both, sketch = np.zeros((len(sets), 2 * tables), np.uint64), np.zeros((len(sets), width), np.uint64)
            block: list[int] = []
            total = 0
            full = [k for k, s in enumerate(sets) if len(s)]
            for at, k in enumerate(full):
                block.append(k)
                total += len(sets[k])
                if total >= BLOCK or at + 1 == len(full):
                    both[block], sketch[block] = signatures([sets[j] for j in block], tables, rows, seed)
                    block, total = [], 0
            # The second collection's parts need fewer bits: they are only compared inside a part of the first.
            parts = ((np.ascontiguousarray(both[:, :tables]).view(np.int64), pa.int64()), ((both[:, tables:] >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32()), (sketch.view(np.int64), pa.int64()))
            listed = [pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel(), kind)) for p, kind in parts]
            halves = [np.array([(d >> s) & (2**64 - 1) for d in digests], np.uint64).view(np.int64) for s in (64, 0)]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, halves), *listed], names=["doc_id", "n_shingles", "ha", "hb", "a", "b", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, ha long, hb long, a array<long>, b array<int>, sketch array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """docs(doc_id, text) to doc_id, digest and full set."""

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            sets = [shingles(t.as_py(), hashes, size) for t in batch.column(1)]
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
            halves = [pa.array(np.array([(d >> s) & (2**64 - 1) for d in digests], np.uint64).view(np.int64)) for s in (64, 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *halves, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "ha", "hb", "items"])

    return docs.mapInArrow(run, "id long, ha long, hb long, items array<long>")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links(x, y) to (node, least): the smallest node that each linked node other than it can reach.

    Alternates large and small stars until nothing changes. Minima are aggregated before they are joined back, so the many neighbours of
    one node are never gathered, and the join can be split where one node has many.
    """
    edges = links.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    state, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.save(large, f"large{step}")
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(own, "u")
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.save(small, f"small{step}")
        row = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if step:
            scratch.drop(f"small{step - 1}")
        scratch.drop(f"large{step}")
        if tuple(row) == state:
            return small.select(F.col("u").alias("node"), F.col("v").alias("least"))
        edges, state, step = small, tuple(row), step + 1


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Sets of n and m items can reach the likeness."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _near(one: Column, two: Column, hashes: int, percent: int) -> Column:
    """Sketches that agree as often as those of sets that reach the likeness, but for 5.5 standard deviations."""
    share = (1 + percent / 100) / 2
    apart = F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return apart <= hashes - int(hashes * share - 5.5 * (hashes * share * (1 - share)) ** 0.5)


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, tables: int = 16, rows: int = 4, seed: int = 19, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's near-duplicate group: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 x shared shingles >= percent x all their shingles. Documents of equal sets form a class, of which one set is
    compared. Two collections of `tables` parts, each joined from `rows` minimum hashes, are paired into tables x tables keys: keys of
    2 x rows hashes from only 2 x tables x rows of them. Sets are dealt by the parts of the first collection, and where a part is
    shared, grouped with those of the second. Of the sets that share a key each is paired with the one of smallest id, its head: first
    with its smallest head of all keys, then, where these links don't connect it with another head, with that too. Where a key's sets are then
    still in different components, pairs across them are compared, but for those that can't reach the likeness as they share none of
    their rare items. Pairs whose sizes or sketches can't reach it are left out; all others are confirmed on their full sets. A pair at a likeness of 0.8 shares no key with a probability of 0.0005 at the
    defaults, one at 0.9 of less than 1e-6; sketches lose about 2e-8 of pairs.

    Null and empty texts and those of white space have no shingles and are linked with nothing; texts of fewer words than a shingle have
    one, of all their words. Rows with null ids can't be named: they stay apart, component_id null, and are kept. Repeated rows
    get the same result each; rows of one id but other texts each get that of their text. Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "dedup")
    hashes = 2 * tables * rows
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    signed = scratch.save(_signed(slim, shingle, tables, rows, seed), "signed")
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    first = named.groupBy("ha", "hb").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("a", "b", "sketch")])
    classes = scratch.save(first, "classes")
    # Sets of fewer than four items reach 0.8 only if they are equal; with other limits the least number is another.
    least = max(1, -(-percent // (100 - percent))) if percent < 100 else 2**31 - 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.filter(F.col("n") >= least).select("id", "n", "b", "sketch", F.posexplode("a").alias("i", "part")).withColumn("part", F.xxhash64("part", "i")).drop("i")
    dealt = dealt.repartition(parts, "part").withColumn("sharing", F.count(F.lit(1)).over(Window.partitionBy("part"))).filter("sharing > 1")
    keyed = dealt.select("part", "id", "n", "sketch", F.posexplode("b").alias("j", "other"))
    group = Window.partitionBy("part", "j", "other")
    met = keyed.withColumn("head", F.min(F.struct("id", "n", "sketch")).over(group)).withColumn("size", F.count(F.lit(1)).over(group)).filter("size > 1 and id <> head.id")
    can = _alike(F.col("n"), F.col("head.n"), percent) & _near(F.col("sketch"), F.col("head.sketch"), hashes, percent)
    met = scratch.save(met.select(F.xxhash64("part", "j", "other").alias("key"), "id", F.col("head.id").alias("head"), "size", can.alias("can")), "met")
    digests = classes.select("id", "ha", "hb")

    def full(ids: DataFrame, name: str) -> DataFrame:
        """The whole sets of ids(id)."""
        wanted = scratch.save(ids.distinct().join(digests, "id"), f"wanted-{name}")
        # Few ids go to the texts; many are met by a shuffle of both.
        chosen = slim.join(bounded_broadcast(wanted.select(F.col("id").alias("doc_id")), wanted.count()), "doc_id", "left_semi")
        return scratch.save(_sets(chosen, shingle).join(wanted, ["id", "ha", "hb"]).dropDuplicates(["id"]).select("id", "items"), f"sets-{name}")

    def confirmed(pairs: DataFrame, name: str, sets: DataFrame | None = None) -> DataFrame:
        """The pairs (x, y) that are linked."""
        pairs = scratch.save(pairs, f"pairs-{name}")
        sets = full(pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))), name) if sets is None else sets
        one, two = (sets.select(F.col("id").alias(k), F.col("items").alias(f"items_{k}")) for k in ("x", "y"))
        shared = F.size(F.array_intersect("items_x", "items_y"))
        both = pairs.join(one, "x").join(two, "y").select("x", "y", shared.alias("shared"), (F.size("items_x") + F.size("items_y")).alias("items"))
        out = scratch.save(both.filter(100 * F.col("shared") >= percent * (F.col("items") - F.col("shared"))).select("x", "y"), f"links-{name}")
        scratch.drop(f"sets-{name}")
        return out

    links = confirmed(met.filter("can").groupBy(F.col("id").alias("x")).agg(F.min("head").alias("y")), "first")
    found = components(links, scratch)

    def placed(df: DataFrame, column: str, into: str) -> DataFrame:
        return df.join(found.select(F.col("node").alias(column), F.col("least").alias(into)), column, "left").withColumn(into, F.coalesce(into, column))

    heads = placed(placed(met.filter("can"), "id", "of_id"), "head", "of_head").filter("of_id <> of_head")
    more = confirmed(heads.select(F.col("id").alias("x"), F.col("head").alias("y")).distinct(), "heads")
    if not more.isEmpty():
        links = scratch.save(links.unionByName(more), "links-two")
        found = components(links, scratch)
    # Sets of keys that are not yet all connected; the keys' heads have been compared with all of them.
    large = placed(met.filter("size > 2"), "id", "of").select("id", F.min("of").over(Window.partitionBy("key")).alias("lo"), F.max("of").over(Window.partitionBy("key")).alias("hi"))
    rest = scratch.save(large.filter("lo <> hi").select("id").distinct(), "open")
    if not rest.isEmpty():
        sets = full(rest, "others")
        items = sets.select("id", F.explode("items").alias("item"))
        few = items.groupBy("item").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") <= RARE)
        rare = scratch.save(items.join(few, "item"), "rare")
        own = rare.groupBy("id").agg(F.count(F.lit(1)).alias("own"))
        info = placed(rest, "id", "of").join(classes.select("id", "n", "sketch", "a", "b"), "id").join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        info = scratch.save(info, "info")

        def across(left: DataFrame, right: DataFrame, on: str, where: Column) -> DataFrame:
            left, right = left.alias("l"), right.alias("r")
            likely = (F.col("l.id") > F.col("r.id")) & (F.col("l.of") != F.col("r.of")) & _alike(F.col("l.n"), F.col("r.n"), percent) & _near(F.col("l.sketch"), F.col("r.sketch"), hashes, percent)
            return left.join(right, (F.col(f"l.{on}") == F.col(f"r.{on}")) & likely & where).select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))

        # Either two sets share a rare item: those meet by it. Or none of their rare items is shared, and all of them lie in the union only.
        by_item = rare.filter("c > 1").select("id", "item").join(info.select("id", "of", "n", "sketch"), "id")
        most = F.least(F.col("l.n") - F.col("l.own"), F.col("r.n") - F.col("r.own"))
        could = 100 * most >= percent * F.greatest(F.col("l.n") + F.col("r.own"), F.col("r.n") + F.col("l.own"))
        # Sets that share several parts are paired in the first of them alone, and only if they share a key there.
        same = lambda c: F.zip_with(F.col(f"l.{c}"), F.col(f"r.{c}"), lambda x, y: x == y)
        shared = (F.array_position(same("a"), True) - 1 == F.col("l.i")) & F.exists(same("b"), lambda x: x)
        by_part = info.select("*", F.posexplode("a").alias("i", "part")).withColumn("part", F.xxhash64("part", "i"))
        pairs = across(by_item, by_item, "item", F.lit(True)).unionByName(across(by_part, by_part, "part", could & shared)).distinct()
        extra = confirmed(pairs, "others", sets)
        if not extra.isEmpty():
            found = components(links.unionByName(extra), scratch)
    for name in ("met", "open", "rare", "info"):
        scratch.drop(name)
    of = classes.select("ha", "hb", "id").join(found, F.col("id") == F.col("node"), "left").select("ha", "hb", F.coalesce("least", "id").alias("group"))
    out = signed.select("doc_id", "n_shingles", "ha", "hb").join(of, ["ha", "hb"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("group")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents with the smallest id of their groups, with docs' columns. Of rows with one id and one text, one stays; rows of one id that have other texts stay or go with it. Rows with null ids stay."""
    scratch, own = Scratch(docs.sparkSession, "first"), unused(docs, "dropped")
    groups = scratch.save(near_duplicates(docs, **options), "groups")
    # While they are few the ids go to the texts; otherwise both meet by a shuffle.
    dropped = scratch.save(groups.filter("not kept").select(F.col("doc_id").alias(own)).distinct(), "dropped")
    out = docs.join(bounded_broadcast(dropped, dropped.count()), F.col("doc_id").cast("long") == F.col(own), "left_anti")
    again = groups.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(own)
    again = scratch.save(again, "again")
    n = again.count()
    if not n:
        return out
    again = bounded_broadcast(again, n)
    match = F.col("doc_id").cast("long") == F.col(own)
    return out.join(again, match, "left_anti").unionByName(out.join(again, match, "left_semi").dropDuplicates(["doc_id", "text"]))

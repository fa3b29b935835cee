"""WARC archives: writing, and reading by boundary-chain verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded_broadcast, shipped

shipped(__name__)

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four of base 32."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(data), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS32, BASE32)


def classified(pages: DataFrame, *, smallest: int = 0, id_column: str = "page_id", url_column: str | None = "url", payload_column: str = "html") -> DataFrame:
    """id, url, payload, digest, bytes and first of each page, the id that a revisit refers to, null for responses. Other columns of pages are left behind.

    Of rows with equal payloads of at least `smallest` bytes those with the smallest id are responses, so repeated rows of it all are; rows
    with null ids refer to it like others, and are responses where no row has an id. Only digests that several rows have are kept in a table,
    from minima that are aggregated first. While it has few rows it goes to the payloads; a larger one is met by a shuffle, where
    Spark can split a payload that many rows share.
    """
    payload = F.coalesce(F.col(payload_column), F.lit(""))
    url = F.col(url_column).cast("string") if url_column and url_column in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_column).alias("id"), url.alias("url"), payload.alias("payload"), base32_sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    firsts = rows.filter(F.col("bytes") >= smallest).groupBy("digest", "bytes").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1 and least is not null")
    firsts = Scratch(pages.sparkSession, "firsts").save(firsts.select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "least"), "firsts")
    out = rows.join(bounded_broadcast(firsts, firsts.count()), (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    return out.select("id", "url", "payload", "digest", "bytes", F.when(~F.col("id").eqNullSafe(F.col("least")), F.col("least")).alias("first"))


def write(pages: DataFrame, path: str, *, id_column: str = "page_id", url_column: str | None = "url", payload_column: str = "html", smallest: int = 0) -> None:
    """A WARC record for each row: response, or revisit without payload. Spark's text writer ends each record with the format's two empty lines.

    Null payloads are empty. The id is a header of its own (left out where null), and so are the payload's length and digest.
    """
    rows = classified(pages, smallest=smallest, id_column=id_column, url_column=url_column, payload_column=payload_column)
    first = F.col("first")
    lines = [
        F.when(first.isNull(), "WARC-Type: response").otherwise("WARC-Type: revisit"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Page-ID: "), F.col("id").cast("string")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", "")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), first.cast("string"), F.lit(">")),
        F.when(first.isNotNull(), "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.concat(F.lit("Content-Length: "), F.when(first.isNull(), F.col("bytes")).otherwise(0).cast("string")),
    ]
    record = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(END), F.when(first.isNull(), F.col("payload")).otherwise(""))
    rows.select(record.alias("value")).write.mode("overwrite").option("lineSep", END).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every magic, be it a record's or a payload's: file, block, row, value, size.

    Spark's text reader splits large files into blocks and gives each piece to one of them. `row` counts a block's pieces in order; size is in bytes.
    """
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value", F.octet_length("value").cast("long").alias("size"))


def header(name: str) -> Column:
    return F.regexp_extract("head", rf"(?:^|\n){name}: ?([^\r\n]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Each place after a magic as a candidate record: its offset, its successor's if it were a record, and what its header says."""
    cut = pieces(spark, path)
    end = F.instr("value", END)
    slim = cut.withColumn("head", F.when(end > 0, F.substring("value", F.lit(1), end)))
    length = F.regexp_extract("head", r"(?:^|\n)Content-Length: ?([0-9]{1,18})(?:\r|$)", 1).try_cast("long")
    payload = F.substring(F.expr(f"left(value, length(value) - {len(END)})"), end + len(END), F.lit(2**31 - 1))
    slim = slim.withColumn("length", length)
    whole = (F.octet_length("head") + 3 + F.col("length") + len(END)) == F.col("size")
    slim = slim.select(
        "file", "block", "row", "size", (F.octet_length("head") + 3).cast("long").alias("head_size"), "length", whole.alias("whole"),
        header("WARC-Type").alias("type"), header("WARC-Page-ID").alias("page_id"), header("WARC-Payload-Length").try_cast("long").alias("bytes"), F.regexp_extract("head", r"(?:^|\n)WARC-Payload-Digest: ?sha1:([A-Z2-7]+)", 1).alias("digest"), F.regexp_extract("head", r"(?:^|\n)WARC-Refers-To: ?<urn:page:([^>]*)>", 1).alias("refers_to"),
        F.when(whole, F.octet_length(payload).cast("long")).alias("read_bytes"), F.when(whole, base32_sha1(payload.cast("binary"))).alias("read_digest"),
    )
    return slim


def placed(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidates with offset: bytes before the piece, counted inside each block and then over a file's blocks, less its magic."""
    step = len(MAGIC)
    inside = slim.withColumn("upto", F.sum(F.col("size") + step).over(Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("place", F.row_number().over(Window.partitionBy("file", "block").orderBy("row")))
    inside = scratch.save(inside, "inside")
    blocks = inside.groupBy("file", "block").agg(F.max("upto").alias("total"), F.max("row").alias("last"))
    before = F.sum("total").over(Window.partitionBy("file").orderBy("block")) - F.col("total")
    blocks = blocks.select(F.col("file").alias("f"), F.col("block").alias("b"), before.alias("before"))
    out = inside.join(blocks, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b")
    start = F.col("before") + F.col("upto") - F.col("size") - step
    # What precedes a file's first magic is no candidate; its piece starts at 0.
    return out.withColumn("at", (start - step).cast("long")).filter("at >= 0").withColumn("next", (F.col("at") + step + F.col("head_size") + F.col("length") + len(END)).cast("long")).drop("upto", "before")


def _exits(table: pa.Table) -> pa.Table:
    """For each candidate of a block the offset at which the chain that starts there leaves the block; null where it breaks off inside."""
    order = np.argsort(table.column("at").to_numpy())
    table = table.take(pa.array(order))
    at, after = table.column("at").to_numpy(), table.column("next").to_numpy(zero_copy_only=False)
    last = int(table.column("block_end")[0].as_py())
    out = np.full(len(at), -1, np.int64)
    for k in range(len(at) - 1, -1, -1):  # successors lie behind, so their exits are known
        if after[k] == after[k]:
            target = int(after[k])
            if target > at[-1] and target >= last:
                out[k] = target
            else:
                j = int(np.searchsorted(at, target))
                if j < len(at) and at[j] == target:
                    out[k] = out[j]
                elif target > at[-1]:
                    out[k] = target
    return pa.table({"file": table.column("file"), "block": table.column("block"), "at": table.column("at"), "exit": pa.array(out)})


def _walk(table: pa.Table) -> pa.Table:
    """The candidates of a block that the chain from its entry reaches."""
    order = np.argsort(table.column("at").to_numpy())
    table = table.take(pa.array(order))
    at, after = table.column("at").to_numpy(), table.column("next").to_numpy(zero_copy_only=False)
    here, out = int(table.column("entry")[0].as_py()), []
    k = int(np.searchsorted(at, here))
    while k < len(at) and at[k] == here:
        out.append(k)
        if after[k] != after[k]:
            break
        here = int(after[k])
        k = int(np.searchsorted(at, here))
    table = table.take(pa.array(out, pa.int64()))
    return pa.table({name: table.column(name) for name in ("file", "block", "at")})


def reachable(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, block, at) of the candidates that the chain from their file's start reaches.

    Inside a block, of bounded bytes, a task follows the chains by itself. Between blocks pointers are doubled: each round joins what is
    reached with pointers twice as long, so a file of n blocks takes about log2(n) rounds over a few rows for each block.
    """
    slim = scratch.save(found.select("file", "block", "at", "next"), "slim")
    ends = Window.partitionBy("file", "block")
    exits = slim.withColumn("block_end", F.max("at").over(ends) + 1).groupBy("file", "block").applyInArrow(_exits, "file string, block long, at long, exit long")
    exits = scratch.save(exits, "exits")
    starts = slim.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    doors = exits.filter("exit >= 0").select("file", F.col("exit").alias("at")).union(starts).distinct()
    nodes = scratch.save(exits.join(doors, ["file", "at"]).select("file", "at", "block", "exit"), "doors")
    jump = nodes.select("file", "at", F.col("exit").alias("to"))
    reached, step = scratch.save(starts, "reached"), 0
    while True:
        step += 1
        new = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).filter("at >= 0")
        both = scratch.save(reached.union(new).distinct(), f"reached{step}")
        if both.count() == reached.count():
            break
        twice = jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("then")), ["file", "to"]).select("file", "at", F.col("then").alias("to"))
        jump, reached = scratch.save(twice, f"jump{step}"), both
    entries = nodes.join(both, ["file", "at"], "left_semi").select("file", "block", F.col("at").alias("entry"))
    inside = slim.join(entries, ["file", "block"])
    return inside.groupBy("file", "block", "entry").applyInArrow(_walk, "file string, block long, at long")


def read(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """The records of all archives under path: type, page_id, bytes, digest, refers_to as their headers say, and what was read.

    Every magic is a candidate; those that the chain of lengths from a file's start doesn't reach lie in payloads and are no records.
    A record whose payload holds magics is put together from its pieces. read_bytes and read_digest are of the block as it was read;
    payloads=True adds `payload`.
    """
    scratch = Scratch(spark, "warc")
    found = scratch.save(placed(candidates(spark, path), scratch), "found")
    true = scratch.save(reachable(found, scratch), "true")
    records = found.join(true, ["file", "block", "at"])
    names = ["file", "at", "type", "page_id", "bytes", "digest", "refers_to"]
    plain = records.filter("whole").select(*names, "read_bytes", "read_digest", "block", "place", "length")
    broken = scratch.save(records.filter("not whole"), "broken")
    out = plain.drop("block", "place", "length")
    several = not broken.isEmpty()
    if several or payloads:
        cut = pieces(spark, path)
        cut = cut.withColumn("place", F.row_number().over(Window.partitionBy("file", "block").orderBy("row")))
    if several:
        # The pieces behind each broken record, up to the next record: those that are no records themselves.
        inner = found.join(true, ["file", "block", "at"], "left_anti").select("file", "block", "at", "place")
        heads = broken.select("file", "block", "at", "place", F.col("at").alias("of"))
        order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        parts = inner.withColumn("of", F.lit(None).cast("long")).unionByName(heads).withColumn("of", F.last("of", ignorenulls=True).over(order)).filter("of is not null")
        value = F.when(F.col("at") == F.col("of"), F.col("value")).otherwise(F.concat(F.lit(MAGIC), F.col("value")))
        texts = cut.join(parts, ["file", "block", "place"]).groupBy("file", "of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", value.alias("v")))), lambda x: x["v"]), "").alias("value"))
        whole = broken.join(texts.withColumnRenamed("of", "at"), ["file", "at"])
        body = F.expr("substring(cast(value as binary), cast(head_size + 1 as int), cast(length as int))").cast("string")
        whole = whole.withColumn("payload", body)
        joined = whole.select(*names, F.octet_length("payload").cast("long").alias("read_bytes"), base32_sha1(F.col("payload").cast("binary")).alias("read_digest"), "payload")
        joined = scratch.save(joined, "joined")
        out = out.unionByName(joined.drop("payload"))
    if payloads:
        body = F.expr("substring(cast(value as binary), cast(head_size + 1 as int), cast(length as int))").cast("string")
        mine = cut.join(records.filter("whole").select("file", "block", "place", "at", "head_size", "length"), ["file", "block", "place"]).select("file", "at", body.alias("payload"))
        mine = mine.unionByName(joined.select("file", "at", "payload")) if several else mine
        out = out.join(mine, ["file", "at"])
    return out


def round_trip(pages: DataFrame, path: str, **options) -> DataFrame:
    """Write pages as archives under path, and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Lengths and digests of responses are of what was read; those of revisits, which have no payload, are their headers'.
    """
    write(pages, path, **options)
    kind = pages.schema[options.get("id_column", "page_id")].dataType
    got = read(pages.sparkSession, path)
    revisit = F.col("type") == "revisit"
    empty = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return got.select(
        empty("page_id").alias("page_id"),
        F.when(revisit, F.col("bytes")).otherwise(F.col("read_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("read_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        empty("refers_to").alias("refers_to"),
    )

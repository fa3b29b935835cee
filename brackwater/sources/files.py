"""Files as tables: recursive scans with ignore rules, content hashes, directory hashes and differences between two scans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder, saved

# Names that a scan leaves out, wherever they stand in a path, and endings.
IGNORED_NAMES = (".git", ".svn", ".hg", "__pycache__", ".pytest_cache", ".mypy_cache", "node_modules", "venv", "env", ".env", ".idea", ".vscode", ".DS_Store", "Thumbs.db")
IGNORED_ENDINGS = (".pyc", ".pyo", ".class")


def ignored(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED_NAMES])) | path.rlike("(" + "|".join(re.escape(x) for x in IGNORED_ENDINGS) + ")$")


def glob_regex(pattern: str) -> str:
    """A wild-match pattern as a regex over paths below the root."""
    body, anchored = pattern.strip().rstrip("/"), "/" in pattern.strip().rstrip("/")
    out = ""
    k = 0
    body = body.lstrip("/")
    while k < len(body):
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        elif body[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + re.escape(body[k]), k + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if pattern.strip().endswith("/") else "(?:/|$)")


def ignored_by(path: Column, patterns: list[str]) -> Column:
    """The last pattern that matches decides; a leading ! takes a path in again."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if p and not p.startswith("#"):
            negated = p.startswith("!")
            out = F.when(path.rlike(glob_regex(p[negated:])), F.lit(not negated)).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, glob: str = "*.java", patterns: list[str] | None = None) -> DataFrame:
    """path below root, parent, name, size, modified, hash, source: text decoded as UTF-8, null where it is not."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(root.strip("/")) + "/", "")
    out = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"), F.expr("if(is_valid_utf8(cast(content as string)), cast(content as string), null)").alias("source"))
    out = out.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("parent", F.regexp_replace("path", "/?[^/]*$", ""))
    out = out.filter(~ignored(F.col("path")))
    return out.filter(~ignored_by(F.col("path"), patterns)) if patterns else out


def directory_hash(files: DataFrame) -> DataFrame:
    """(parent, hash): SHA-256 over the children's hashes and names in order of names; children of one directory are gathered."""
    kids = F.array_sort(F.collect_list(F.struct("name", "hash")))
    return files.groupBy("parent").agg(F.sha2(F.array_join(F.transform(kids, lambda x: F.concat(x["hash"], x["name"])), ""), 256).alias("hash"))


def tree_hashes(files: DataFrame) -> DataFrame:
    """files(path, hash) with all directories up to the root, whose path is empty: (path, hash, is_file). A directory's hash needs its children's in one row, and no more: one level after the other, from the deepest."""
    nodes = files.select("path", "hash", F.lit(True).alias("is_file"), F.size(F.split("path", "/")).alias("depth"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    out, level = nodes, None
    for depth in range(deepest, 0, -1):
        here = nodes.filter(F.col("depth") == depth)
        here = here if level is None else here.unionByName(level)
        kids = here.select(F.regexp_replace("path", "/?[^/]*$", "").alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name"), "hash")
        level = directory_hash(kids).select(F.col("parent").alias("path"), "hash", F.lit(False).alias("is_file"), F.lit(depth - 1).alias("depth"))
        level = saved(level, "level")
        out = out.unionByName(level)
    return out.drop("depth")


def file_count(files: DataFrame, glob: str = "*") -> DataFrame:
    """(directory, n): how many files below each top directory match."""
    return files.filter(F.col("path").rlike(glob_regex(glob))).groupBy(F.element_at(F.split("path", "/"), 1).alias("directory")).agg(F.count(F.lit(1)).alias("n"))


def diff(old: DataFrame, new: DataFrame, full: bool = True) -> DataFrame:
    """(path, change): new, modified, and with full also deleted."""
    a, b = old.select("path", F.col("hash").alias("a")), new.select("path", F.col("hash").alias("b"))
    out = a.join(b, "path", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    out = out.select("path", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").otherwise("modified").alias("change"))
    return out if full else out.filter("change <> 'deleted'")


def stored_tree(found: DataFrame) -> DataFrame:
    """files(path, hash) as their tree on disk: depth, parent, path, hash, is_file, a folder for each depth, so that a level is read by itself."""
    nodes = tree_hashes(found).withColumn("depth", F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))))
    nodes = nodes.withColumn("parent", F.regexp_replace("path", "/?[^/]*$", ""))
    path = new_folder(found.sparkSession, "tree")
    nodes.write.partitionBy("depth").parquet(path)
    return found.sparkSession.read.schema("path string, hash string, is_file boolean, parent string, depth int").parquet(path)


def changed_below(old: DataFrame, new: DataFrame, broadcast: int = 200_000) -> tuple[DataFrame, list[int]]:
    """diff of two stored trees, level by level from the top: (path, change), and how many nodes of each level were looked at.

    A level's nodes are met in both trees only if their directories' hashes differ; equal directories are left closed with all below them. A
    directory that only one tree has is opened there, so its files are new or deleted; a path that is a file in one and a directory in the other is both.
    Empty trees have no root and differ in everything.
    """
    spark = old.sparkSession
    node = "path string, a string, b string, a_file boolean, b_file boolean"
    out, looked, opened, depth = spark.createDataFrame([], "path string, change string"), [], None, 0
    while True:
        sides = []
        for tree, hash_, file_ in ((old, "a", "a_file"), (new, "b", "b_file")):
            level = tree.filter(F.col("depth") == depth)
            if opened is not None:
                level = level.join(F.broadcast(opened) if count <= broadcast else opened, F.col("parent") == F.col("open"), "left_semi")
            sides.append(level.select("path", F.col("hash").alias(hash_), F.col("is_file").alias(file_)))
        met = saved(sides[0].join(sides[1], "path", "full_outer").select(*[c.split()[0] for c in node.split(", ")]), "met")
        looked.append(met.count())
        differ = met.filter(~F.col("a").eqNullSafe(F.col("b")) | ~F.col("a_file").eqNullSafe(F.col("b_file")))
        was, now = F.coalesce("a_file", F.lit(False)), F.coalesce("b_file", F.lit(False))
        out = out.unionByName(differ.filter(was | now).select("path", F.when(was & now, "modified").when(was, "deleted").otherwise("new").alias("change")))
        opened = differ.filter((F.col("a_file") == False) | (F.col("b_file") == False)).select(F.col("path").alias("open"))  # noqa: E712
        count = opened.count()
        if not count:
            return out, looked
        depth += 1

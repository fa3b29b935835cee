"""Vector queries over the embeddings table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..operators import store, vector, vector_index
from ..session import new_folder, table
from ..sources.paging import PagedTable
from .registry import query

V = "embedding::DOUBLE[]"
Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
FUNCTIONS = {"Cosine": ("list_cosine_similarity", "DESC"), "Dot": ("list_inner_product", "DESC"), "Euclid": ("list_distance", "ASC"), "Manhattan": (None, "ASC")}


def points(spark, sf):
    return table(spark, sf, "embeddings")


def first_vector(spark, sf):
    return points(spark, sf).filter("vec_id = 0").first()["embedding"]


def _knn(name: str, metric: str):
    f, order = FUNCTIONS[metric]
    score = f"{f}({V}, {Q})" if f else f"list_sum(list_transform(list_zip({V}, {Q}), lambda x: abs(x[1] - x[2])))"

    @query(f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, {score} AS score FROM embeddings) ORDER BY score {order}, vec_id LIMIT 10", name)
    def run(spark, sf):
        return vector.search(points(spark, sf), first_vector(spark, sf), metric=metric, limit=10).select("vec_id", F.round("score", 6).alias("score"))


for _name, _metric in (("knn_cosine", "Cosine"), ("knn_dot", "Dot"), ("knn_euclid", "Euclid"), ("knn_manhattan", "Manhattan")):
    _knn(_name, _metric)


@query(f"SELECT vec_id, label, round(score, 6) AS score FROM (SELECT vec_id, label, list_cosine_similarity({V}, {Q}) AS score FROM embeddings WHERE label IN (1, 2, 3)) WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 20")
def knn_filtered_threshold(spark, sf):
    return vector.search(points(spark, sf), first_vector(spark, sf), limit=20, threshold=0.1, where=F.col("label").isin(1, 2, 3)).select("vec_id", "label", F.round("score", 6).alias("score"))


def _many(name: str, every: int, limit: int):
    @query(f"SELECT query, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT q.vec_id AS query, p.vec_id, list_cosine_similarity(p.{V}, q.{V}) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(p.{V}, q.{V}), 9) DESC, p.vec_id) AS rank FROM embeddings p JOIN embeddings q ON q.vec_id % {every} = 0 AND p.vec_id <> q.vec_id) WHERE rank <= {limit}", name)
    def run(spark, sf):
        wanted = points(spark, sf).filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
        return vector.search_many(points(spark, sf), wanted, limit=limit).select("query", "vec_id", "rank", F.round("score", 6).alias("score"))


_many("knn_multi_query", 50, 5)
_many("all_pairs_topk", 1, 3)


@query("SELECT count(*) AS points, min(len(embedding)) AS least_size, max(len(embedding)) AS most_size FROM embeddings")
def collection_info(spark, sf):
    out = vector.collection_info(points(spark, sf))
    return out.select("points", F.col("least_size").cast("bigint").alias("least_size"), F.col("most_size").cast("bigint").alias("most_size"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 9 = 0")
def vector_upsert_dedupe(spark, sf):
    p = points(spark, sf).select("vec_id", "label").withColumn("seq", F.lit(0))
    changed = p.filter("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("seq"))
    new = p.filter("vec_id % 9 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), "label", F.lit(1).alias("seq"))
    return store.upsert(p, changed.unionByName(new), ("vec_id",)).drop("seq")


@query("SELECT label, count(*) AS n FROM embeddings WHERE NOT (label IN (2, 5)) AND vec_id % 10 <> 1 GROUP BY 1")
def vector_delete_by_filter(spark, sf):
    p = points(spark, sf)
    gone = p.filter("vec_id % 10 = 1").select("vec_id")
    return store.delete(p, gone, F.col("label").isin(2, 5), key="vec_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, label FROM embeddings")
def scroll_no_vectors(spark, sf):
    return points(spark, sf).select("vec_id", "label")


@query("""WITH b AS (SELECT vec_id, label, (row_number() OVER (ORDER BY vec_id) - 1) // (SELECT CAST(greatest(1, ceil(count(*) / 5.0)) AS BIGINT) FROM embeddings) AS page FROM embeddings)
SELECT CAST(page AS INTEGER) AS page, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last, sum(label) AS labels FROM b GROUP BY page""")
def scrolled_pages(spark, sf):
    """All points in five pages by cursor, vectors left where they are."""
    p = points(spark, sf)
    held = PagedTable.write(p, new_folder(spark, "pages"), "vec_id", rows_per_file=1000)
    size = -(-p.count() // 5)
    pages = [page.select(F.lit(k).alias("page"), "vec_id", "label") for k, page in enumerate(held.scroll(size, without=("embedding",)))]
    return reduce(DataFrame.unionByName, pages).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.sum("label").alias("labels"))


@query(f"SELECT vec_id, round(sqrt(list_inner_product({V}, {V})), 6) AS norm FROM embeddings")
def vector_norms(spark, sf):
    return points(spark, sf).select("vec_id", F.round(similarity.norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT doc_id, round(list_sum(list_transform(range(1, 9), lambda i: ('0x' || substr(md5(text || '|' || i), 1, 8))::UBIGINT / 4294967296.0)), 6) AS total FROM documents")
def hash_embedding(spark, sf):
    v = similarity.hash_embedding(F.col("text"), 8)
    return table(spark, sf, "documents").select("doc_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("WITH cache AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 4 = 0) SELECT doc_id, CASE WHEN key IS NULL THEN 'miss' ELSE 'hit' END AS found FROM documents LEFT JOIN cache ON key = sha256(text)")
def cache_hit_miss(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    cache = docs.filter("doc_id % 4 = 0").select("key").distinct().withColumn("hit", F.lit(True))
    return docs.join(cache, "key", "left").select("doc_id", F.when(F.col("hit"), "hit").otherwise("miss").alias("found"))


@query()
def ivf_search(spark, sf):
    wanted = points(spark, sf).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return vector.ivf_search(vector.ivf_index(points(spark, sf), cells=16), wanted, probes=10, limit=5)


#: Of each session and folder, the index of its vectors.
INDEXES: dict[tuple[str, str], vector_index.VectorIndex] = {}


def _index(spark, sf) -> vector_index.VectorIndex:
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in INDEXES:
        INDEXES[key] = vector_index.build(points(spark, sf), new_folder(spark, "index"), cells=40, parts=32, words=64)
    return INDEXES[key]


def _wanted(spark, sf):
    return points(spark, sf).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@query()
def stored_index_search(spark, sf):
    """Every row in an index on disk; queries look at 30 of 40 cells by codes, and at 100 vectors. A tenth of the cells holds two fifths of the true neighbours of these vectors, which lie about evenly."""
    return vector_index.search(_index(spark, sf), _wanted(spark, sf), probes=30, limit=5, candidates=100).select("query", "vec_id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT q.vec_id AS query, p.vec_id, list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings p ON p.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query, vec_id, round(score, 6) AS score FROM s WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) <= 20""")
def search_as_preset(spark, sf):
    """A preset's search of many queries: below its full_scan_threshold of points by all vectors."""
    out = vector_index.search_as(_index(spark, sf), points(spark, sf), _wanted(spark, sf), vector.for_collection("java_methods"), threshold=0.25, full_scan_threshold=10**9)
    return out.select("query", "vec_id", F.round("score", 6).alias("score"))


@query()
def pca2d(spark, sf):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = points(spark, sf).select("vec_id", "label", array_to_vector("embedding").alias("v"))
    flat = vector_to_array(F.col("p"))
    return PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).select("vec_id", "label", flat[0].alias("x"), flat[1].alias("y"))

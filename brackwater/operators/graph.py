"""Graph traversal: neighbours, degrees, breadth-first dependencies, simple paths and reproducible weighted walks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import weights as W
from ..session import new_folder, saved
from .store import top_of

#: Rows of a frontier or a path set that may be broadcast.
BOUND = 200_000


def weight(rel_type: Column, table: dict[str, float]) -> Column:
    """Whole ten-thousandths, so that sums are exact."""
    value = lambda w: F.lit(round(w * W.SCALE))
    return reduce(lambda c, kv: c.when(rel_type == kv[0], value(kv[1])), list(table.items())[1:], F.when(rel_type == next(iter(table)), value(next(iter(table.values()))))).otherwise(value(W.UNKNOWN)).cast("bigint")


def neighbours(rels: DataFrame, table: dict[str, float] = W.BASE, include_reverse: bool = True, nodes: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(node, neighbour, rel_type, n, w). Both ways: a set for each pair and type. Forward only: a bag, whose multiplicity n adds to the weight.

    With nodes(node), only their neighbours: edges elsewhere are left out before any are told apart. The set is found in `parts` tasks, if given, each with its share of the edges.
    """
    out = rels.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbour"), "rel_type")
    if include_reverse:
        both = out.unionByName(rels.select(F.col("target_id").alias("node"), F.col("source_id").alias("neighbour"), "rel_type"))
    else:
        both = out
    both = both if nodes is None else both.join(nodes.select("node"), "node", "left_semi")
    both = both if parts is None else both.repartition(parts, "node", "neighbour", "rel_type")
    if include_reverse:
        both = both.distinct().withColumn("n", F.lit(1).cast("bigint"))
    else:
        both = both.groupBy("node", "neighbour", "rel_type").agg(F.count(F.lit(1)).alias("n"))
    return both.withColumn("w", F.col("n") * weight(F.col("rel_type"), table))


def adjacency(near: DataFrame) -> DataFrame:
    """Each neighbour's share of its node's weight as an interval [lo, hi) of total."""
    order = Window.partitionBy("node").orderBy("neighbour", "rel_type").rowsBetween(Window.unboundedPreceding, 0)
    hi = F.sum("w").over(order)
    return near.select("node", "neighbour", "rel_type", (hi - F.col("w")).alias("lo"), hi.alias("hi"), F.sum("w").over(Window.partitionBy("node")).alias("total"))


@dataclass(frozen=True)
class Strategy:
    """Walks of one kind: how many, how long, along edges both ways or forward only, with factors for types of edges. Of guidance scores, scaled by `guidance`, the even walks take notice, or all."""

    name: str
    steps: int
    walks: int
    forward: bool = False
    factors: tuple[tuple[str, float], ...] = ()
    guidance: float = 0.0
    all_guided: bool = False


def standard(steps: int, walks: int) -> list[Strategy]:
    return [Strategy("shallow_wide", steps // 2, walks * 2), Strategy("deep_narrow", steps * 2, walks // 2), Strategy("balanced", steps, walks), Strategy("forward_only", steps, walks, forward=True)]


def enterprise(steps: int, walks: int) -> list[Strategy]:
    calls, uses = (("CALLS", 1.5),), (("USES", 1.5),)
    every = tuple((t, 1.3) for t in ("CALLS", "USES", "EXTENDS", "IMPLEMENTS", "RETURNS", "PARAMETER"))
    return [
        Strategy("ultra_wide", 3, walks * 3, factors=calls),
        Strategy("deep_exploration", steps * 3, walks // 3, factors=uses),
        Strategy("balanced_enterprise", steps, walks, factors=every),
        Strategy("forward_enterprise", steps, walks, forward=True, factors=calls),
        Strategy("reverse_enterprise", steps, walks, factors=uses),
    ]


def hybrid(steps: int, walks: int) -> list[Strategy]:
    return [Strategy("vector_guided", steps, walks, guidance=0.7), Strategy("markov_heavy", steps * 2, walks, guidance=0.3), Strategy("balanced_hybrid", steps, walks * 2, guidance=0.5)]


def ways(rels: DataFrame) -> DataFrame:
    """(forward, node, neighbour, rel_type, n): the edges both ways as a set, and forward as a bag with its multiplicities."""
    out = rels.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbour"), "rel_type")
    bag = out.groupBy("node", "neighbour", "rel_type").agg(F.count(F.lit(1)).alias("n"))
    both = bag.drop("n").unionByName(bag.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"), "rel_type")).distinct()
    return both.select(F.lit(False).alias("forward"), "*", F.lit(1).cast("bigint").alias("n")).unionByName(bag.select(F.lit(True).alias("forward"), "*"))


def stored(rels: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """ways and the edges as they come in, (node, neighbour, rel_type, n), as tables on disk in buckets by node, sorted by node.

    There is a bucket for half a million edges unless a number is given. Written once, they are joined and grouped by node without a shuffle, and of a few nodes only their buckets are read. A node of very many edges is one
    bucket's; a walk or a search only filters it there.
    """
    spark, out = rels.sparkSession, []
    buckets = buckets or max(8, min(4096, rels.count() // 500_000))
    into = rels.groupBy(F.col("target_id").alias("node"), F.col("source_id").alias("neighbour"), "rel_type").agg(F.count(F.lit(1)).alias("n"))
    for name, rows in (("ways", ways(rels)), ("into", into)):
        path = new_folder(spark, name)
        table = "_".join(path.rpartition("/")[2].split("-"))
        rows.repartition(buckets, "node").write.bucketBy(buckets, "node").sortBy("node").option("path", path).saveAsTable(table)
        out.append(spark.table(table))
    return out[0], out[1]


def edges_at(rels: DataFrame, nodes: list[str]) -> DataFrame:
    """ways' edges at some nodes, from relationships: only edges that touch them are grouped."""
    return ways(rels.filter(F.col("source_id").isin(nodes) | F.col("target_id").isin(nodes))).filter(F.col("node").isin(nodes))


def two_step_counts(rels: DataFrame) -> DataFrame:
    """two_steps of relationships as they come: ends are counted by node and type where the edges lie, before anything is shuffled."""
    one = F.lit(1).cast("bigint").alias("n")
    return two_steps(rels.select(F.lit(True).alias("forward"), F.col("source_id").alias("node"), "rel_type", one), rels.select(F.col("target_id").alias("node"), "rel_type", one))


def two_steps(out: DataFrame, into: DataFrame) -> DataFrame:
    """(first, second, n): how many ways of two edges there are of each two types, from the stored edges: counted at the node between, not way by way."""
    ends = lambda rows, name: rows.groupBy("node", F.col("rel_type").alias(name)).agg(F.sum("n").alias(f"n_{name}"))
    met = ends(into, "first").join(ends(out.filter("forward"), "second"), "node")
    return met.groupBy("first", "second").agg(F.sum(F.col("n_first") * F.col("n_second")).alias("n"))


def draw(*key: Column) -> Column:
    """A uniform number between 0 and 1, both excluded, that depends on the key alone."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def walk(edges: DataFrame, start: str, strategies: list[Strategy], *, table: dict[str, float] = W.BASE, guidance: DataFrame | None = None, seed: int = 42, on_disk: bool = False) -> DataFrame:
    """ways' edges to (strategy, walk, length, path): the walks of all strategies from start move on together, one join a step.

    The edges are written once, here or, on_disk, by `stored`; or they are relationships on disk, of which each step groups those that touch its nodes, and the whole graph is never shuffled. At each step the walks, a checked number of rows, go to the edges of the nodes where they are. Every edge there draws from
    the hash of its key an exponential time of rate w, and the earliest is taken, so that an edge is followed with probability w / sum of w: a minimum, which
    is found in part where the edges lie, so a node with very many edges is no task of its own. Walks are the same however rows are dealt. At a dead end one stops.
    """
    spark = edges.sparkSession
    live = {(s.name, k): [start] for s in strategies for k in range(s.walks)}
    if len(live) > BOUND // max([1, *(s.steps for s in strategies)]):
        raise ValueError(f"{len(live)} walks are too many at once")
    # Sorted by node, so that a step reads the row groups of the nodes where walks are.
    plain = "source_id" in edges.columns
    if not on_disk:
        edges = saved(edges, "edges") if plain else saved(edges.repartitionByRange("node").sortWithinPartitions("node"), "edges")
    of, paths = {s.name: s for s in strategies}, dict(live)
    factor = F.lit(1.0)
    for s in strategies:
        for t, f in s.factors:
            factor = F.when((F.col("strategy") == s.name) & (F.col("rel_type") == t), f).otherwise(factor)
    if guidance is not None:
        found = guidance.select(F.col("node").alias("neighbour"), F.col("score").cast("double")).limit(BOUND + 1).collect()
        if len(found) > BOUND:
            raise ValueError("guidance names too many nodes")
        guidance = F.broadcast(spark.createDataFrame(found, "neighbour string, score double"))
    for step in range(max([0, *(s.steps for s in strategies)])):
        live = {key: p for key, p in live.items() if of[key[0]].steps > step}
        if not live:
            break
        rows = [(s, k, p[-1], of[s].forward, of[s].guidance if of[s].all_guided or k % 2 == 0 else 0.0) for (s, k), p in live.items()]
        here = spark.createDataFrame(rows, "strategy string, walk int, node string, forward boolean, guidance double")
        nodes = sorted({r[2] for r in rows})
        if len(rows) <= 1000:
            met = edges_at(edges, nodes) if plain else edges.filter(F.col("node").isin(nodes))
        else:
            met = ways(edges) if plain else edges
        met = met.withColumn("base", F.col("n") * weight(F.col("rel_type"), table)).drop("n")
        met = met.join(F.broadcast(here), ["node", "forward"]).withColumn("w", F.round(F.col("base") * factor))
        if guidance is not None:
            met = met.join(guidance, "neighbour", "left").withColumn("w", F.round(F.col("w") * (1 + 0.5 * F.coalesce("score", F.lit(0.0)) * F.col("guidance"))))
        u = draw(F.lit(str(seed)), "strategy", F.col("walk").cast("string"), F.lit(str(step)), "node", "neighbour", "rel_type")
        moved = met.filter("w > 0").groupBy("strategy", "walk").agg(F.min_by("neighbour", F.struct(-F.log(u) / F.col("w"), "neighbour")).alias("to")).collect()
        live = {(r["strategy"], r["walk"]): [*paths[r["strategy"], r["walk"]], r["to"]] for r in moved}
        paths |= live
    return spark.createDataFrame([(s, k, len(p) - 1, p) for (s, k), p in sorted(paths.items())], "strategy string, walk int, length int, path array<string>")


def visits(walked: DataFrame) -> DataFrame:
    """(strategy, node, n, prob, first): how often each node was visited, its share, and where it was first met."""
    each = walked.select("strategy", "walk", F.posexplode("path").alias("step", "node"))
    counted = each.groupBy("strategy", "node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("walk", "step")).alias("first"))
    return counted.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("strategy")))


def most_visited(seen: DataFrame, entities: DataFrame, start: str, limit: int = 20) -> DataFrame:
    """The most visited known nodes but the start; ties by where they were first met."""
    known = seen.join(entities.select(F.col("id").alias("node"), "type", "name"), "node").filter(F.col("node") != start)
    return top_of(known, ["strategy"], [F.col("n").desc(), "first", "node"], limit)


def combined(top: DataFrame, limit: int = 30) -> DataFrame:
    """Of each strategy's most visited nodes, with `score` of guidance where there is one, the summed visit shares plus 0.3 times the scores."""
    score = F.col("prob") + (0.3 * F.coalesce("score", F.lit(0.0)) if "score" in top.columns else 0.0)
    total = top.groupBy("node").agg(F.sum(score).alias("combined"), F.count(F.lit(1)).alias("strategies")).withColumnRenamed("combined", "score")
    return total.orderBy(F.round("score", 9).desc(), "node").limit(limit)


def with_guidance(top: DataFrame, guidance: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """The nodes' guidance scores, as much of them as each strategy takes."""
    share = top.sparkSession.createDataFrame([(s.name, s.guidance) for s in strategies], "strategy string, share double")
    out = top.join(guidance.select("node", F.col("score").alias("own")), "node", "left").join(F.broadcast(share), "strategy")
    return out.withColumn("score", F.col("own") * F.col("share")).drop("own", "share")


def degrees(rels: DataFrame) -> DataFrame:
    """In and out edges of each node, as a bag; a loop counts once."""
    ends = rels.select(F.col("source_id").alias("node")).unionByName(rels.filter("source_id <> target_id").select(F.col("target_id").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def connectivity(degree: Column) -> Column:
    return F.when(degree == 0, "ISOLATED").when(degree < 2, "LOW").when(degree < 5, "MODERATE").otherwise("HIGH")


def profile(methods: DataFrame, *keys: str) -> DataFrame:
    """methods(source_code, annotations, modifiers, parameter_types, complexity) to the shares by which projects are told apart."""
    share = lambda c: F.avg(c.cast("int"))
    has = lambda words: reduce(lambda a, b: a | b, [F.col("source_code").contains(w) for w in words])
    return methods.groupBy(*keys).agg(
        share(has(PROFILE_WORDS["gui"])).alias("gui"),
        share(F.size("annotations") > 0).alias("annotated"),
        share(has(PROFILE_WORDS["database"])).alias("database"),
        share(has(PROFILE_WORDS["math"])).alias("math"),
        share(has(PROFILE_WORDS["exceptions"])).alias("exceptions"),
        share(F.array_contains("modifiers", "static")).alias("static"),
        F.avg(F.size("parameter_types")).alias("parameters"),
        F.avg("complexity").alias("complexity"),
        F.count(F.lit(1)).alias("methods"),
    )


# Words that show what code is for.
PROFILE_WORDS = {"gui": ("JFrame", "JButton", "Swing", "ActionListener"), "database": ("ResultSet", "Connection", "SQL", "Statement"), "math": ("Math.", "calculate", "compute", "+", "-", "*", "/"), "exceptions": ("try", "catch")}


def project_type(p: DataFrame) -> Column:
    """The first rule that a profile meets."""
    rules = (
        ((p["methods"] > 30) | (p["complexity"] > 3), "large_enterprise"), (p["gui"] > 0.2, "gui_application"), (p["annotated"] > 0.3, "framework_library"), (p["database"] > 0.15, "data_processing"),
        ((p["math"] > 0.4) | (p["complexity"] < 2), "utility_library"), (p["exceptions"] > 0.3, "business_logic"),
    )
    return reduce(lambda c, r: c.when(*r), rules[1:], F.when(*rules[0])).otherwise("general")


def adaptive_walk(rels: DataFrame, methods: DataFrame, entities: DataFrame, start: str, *, steps: int = 10, walks: int = 5, guidance: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Top nodes of walks that suit the project: (node, score, strategies, project_type, connectivity, calls_weight, strategies_used).

    The profile of all methods gives the project's type, which adapts the weights and, without guidance, chooses the strategies: those of large projects or the standard ones. With guidance they are the hybrid ones.
    """
    degree = degrees(rels).filter(F.col("node") == start)
    status = degree.agg(F.coalesce(F.max("degree"), F.lit(0)).alias("degree")).select(connectivity(F.col("degree")).alias("s")).first()["s"]
    p = profile(methods)
    found = p.select("*", project_type(p).alias("type")).first()
    kind = found["type"] if found["methods"] else "unknown"
    table = W.adapted(kind, found["complexity"] or 0.0, found["methods"])
    plan = hybrid(steps, walks) if guidance is not None else enterprise(steps, walks) if kind == "large_enterprise" else standard(steps, walks)
    walked = walk(ways(rels) if edges is None else edges, start, plan, table=table, guidance=guidance, on_disk=edges is not None)
    top = most_visited(visits(walked), entities, start)
    top = top if guidance is None else with_guidance(top, guidance, plan)
    return combined(top).select("*", F.lit(kind).alias("project_type"), F.lit(status).alias("connectivity"), F.lit(table["CALLS"]).alias("calls_weight"), F.lit(len(plan)).alias("strategies_used"))


def enriched(seen: DataFrame) -> DataFrame:
    """(strategy, nodes, mean_visits, most_visited, visits): how many nodes a strategy's walks met, how often on average, and the one met most; ties by where it was first met."""
    most = F.max_by("node", F.struct("n", -F.col("first.walk"), -F.col("first.step"), "node"))
    return seen.groupBy("strategy").agg(F.count(F.lit(1)).alias("nodes"), F.avg("n").alias("mean_visits"), most.alias("most_visited"), F.max("n").alias("visits"))


def weight_changes(spark: SparkSession, project_type: str, complexity: float, methods: int) -> DataFrame:
    """(rel_type, base, adapted, change) of a project's edge weights."""
    table = W.adapted(project_type, complexity, methods)
    return spark.createDataFrame([(k, W.BASE.get(k, W.UNKNOWN), v, round(v - W.BASE.get(k, W.UNKNOWN), 6)) for k, v in table.items()], "rel_type string, base double, adapted double, change double")


def contributions(top: DataFrame) -> DataFrame:
    """(node, score, contributions): what each strategy adds to a node's combined score: array of struct(strategy, score, visit_prob, guidance_score), by strategy."""
    guide = F.coalesce("score", F.lit(0.0)) if "score" in top.columns else F.lit(0.0)
    one = F.struct("strategy", (F.col("prob") + 0.3 * guide).alias("score"), F.col("prob").alias("visit_prob"), guide.alias("guidance_score"))
    out = top.groupBy("node").agg(F.array_sort(F.collect_list(one)).alias("contributions"))  # a strategy has a node once
    return out.select("node", F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["score"]).alias("score"), "contributions")


def needs_fallback(seen: DataFrame, top: DataFrame) -> bool:
    """Whether walks met too little: fewer than 3 nodes, or fewer than 2 known ones besides the start."""
    return seen.select("node").distinct().limit(3).count() < 3 or top.limit(2).count() < 2


def expanded(seen: DataFrame, top: DataFrame, methods: DataFrame, me, limits: dict[str, int] | None = None) -> DataFrame:
    """(id, prob, strategy): the nodes that walks met most, and, if those are too few, what the fallbacks find besides."""
    met = top.select(F.col("node").alias("id"), "prob", F.lit("walk").alias("strategy"))
    if not needs_fallback(seen, top):
        return met
    have = met.select("id").unionByName(methods.sparkSession.createDataFrame([(me["id"],)], "id string"))
    return met.unionByName(fallback(fallback_sources(methods, me), have, limits).select("id", "prob", "strategy"))


def reach(rels: DataFrame, start: str, depth: int) -> DataFrame:
    """(node, level): breadth-first along edges, the start excluded. Each level is written once, and leaves out what has been seen."""
    edges = rels.select(F.col("source_id").alias("node"), F.col("target_id").alias("next")).distinct()
    edges = saved(edges, "reach-edges") if depth > 1 else edges
    seen = level = rels.sparkSession.createDataFrame([(start, 0)], "node string, level int")
    for k in range(depth):
        new = level.join(edges, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(k + 1))
        level = saved(new, "level")
        seen = seen.unionByName(level)
    return seen.filter("level > 0")


def simple_paths(rels: DataFrame, start: str, end: str, cutoff: int = 5, limit: int = 10) -> DataFrame:
    """Undirected simple paths in order of length, then nodes.

    Only nodes from which the end is near enough are entered: their distances from it are found first, backwards. A level once reached is written,
    and no longer paths are looked for when there are `limit` of them.
    """
    one = rels.filter("source_id <> target_id").select(F.col("source_id").alias("node"), F.col("target_id").alias("next"))
    edges = saved(one.unionByName(one.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct(), "path-edges")
    spark = rels.sparkSession
    far = spark.createDataFrame([(end, 0)], "node string, far int")
    last = far
    for k in range(1, cutoff):
        last = saved(last.join(edges, "node").select(F.col("next").alias("node")).distinct().join(far.select("node"), "node", "left_anti").withColumn("far", F.lit(k)), "far")
        far = far.unionByName(last)
    near_end = far.withColumnRenamed("node", "next")
    paths, done, n = spark.createDataFrame([(start, [start])], "node string, path array<string>"), [], 0
    for k in range(cutoff):
        on = paths.join(edges, "node").filter(~F.array_contains("path", F.col("next"))).join(near_end, "next").filter(F.col("far") < cutoff - k)
        paths = saved(on.select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")), "paths")
        done.append(paths.filter(F.col("node") == end).select("path"))
        n += done[-1].count()
        if n >= limit:
            break
        paths = paths.filter(F.col("node") != end)
    out = reduce(DataFrame.unionByName, done).select(F.concat_ws(" > ", "path").alias("path"), (F.size("path") - 1).alias("length"))
    return out.orderBy("length", "path").limit(limit)


def fuse(graph: DataFrame, vector: DataFrame, dependency: DataFrame, target: str, *, least: float = 0.1, limit: int = 20) -> DataFrame:
    """Ranked context: each (id, score) list weighs 0.7, 0.5 and 1.0; scores add up by id; the target first, then by score, then id descending."""
    part = lambda df, w, s: df.select("id", (F.col("score") * w).alias("score"), F.lit(s).alias("source"))
    all_ = part(graph, 0.7, "graph").unionByName(part(vector, 0.5, "vector")).unionByName(part(dependency, 1.0, "dependency"))
    sums = all_.groupBy("id").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    score = F.round("score", 9)
    return sums.filter(score >= least).orderBy((F.col("id") == target).desc(), score.desc(), F.col("id").desc()).limit(limit)


# Of each fallback the probability and the most rows, in the order in which they are asked.
FALLBACKS = {"class": (0.1, 5), "package": (0.05, 8), "name": (0.08, 5), "returns": (0.06, 4), "parameters": (0.07, 6), "annotations": (0.09, 4), "complexity": (0.06, 5)}


def fallback_sources(methods: DataFrame, me, name_part: str | None = None) -> DataFrame:
    """(strategy, prio, prob, id, name): the methods that are like `me`, a row of methods, in one of seven ways. Each row of methods is read once."""
    last = lambda xs: [x.rpartition(".")[2] for x in xs or []]
    c = me["complexity"] or 0
    lo, hi = (1, 3) if c <= 2 else (c - 1, c + 2) if c <= 5 else (c - 2, c + 3)
    any_of = lambda column, xs: F.arrays_overlap(column, F.array(*[F.lit(x) for x in xs]).cast("array<string>")) if xs else F.lit(False)
    like = {
        "class": F.col("class_id") == me["class_id"],
        "package": F.startswith("package", F.lit(me["package"] or "")) if me["package"] else F.lit(False),
        "name": F.contains(F.lower("name"), F.lit((name_part or me["name"]).lower())),
        "returns": F.col("return_type") == me["return_type"] if me["return_type"] not in (None, "", "void") else F.lit(False),
        "parameters": any_of(F.transform("parameter_types", lambda x: F.element_at(F.split(x, r"\."), -1)), last(me["parameter_types"])),
        "annotations": any_of(F.transform("annotations", lambda x: F.element_at(F.split(x, r"\."), -1)), last(me["annotations"])),
        "complexity": F.col("complexity").between(lo, hi) if c > 0 else F.lit(False),
    }
    rows = [F.when(like[s], F.struct(F.lit(s).alias("strategy"), F.lit(k).alias("prio"), F.lit(p).alias("prob"))) for k, (s, (p, _)) in enumerate(FALLBACKS.items())]
    return methods.select("id", "name", F.explode(F.array_compact(F.array(*rows))).alias("s")).select("s.*", "id", "name")


def fallback(sources: DataFrame, have: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """sources(strategy, prio, id, name, prob): at most limits rows of each strategy, each id once by priority, none that `have` holds."""
    limits = limits or {s: n for s, (_, n) in FALLBACKS.items()}
    top = top_of(sources, ["strategy"], ["name", "id"], max(limits.values()))
    cap = reduce(lambda c, kv: c.when(F.col("strategy") == kv[0], kv[1]), limits.items(), F.when(F.lit(False), 0)).otherwise(0)
    kept = top.filter(F.col("rank") <= cap).join(have.select("id"), "id", "left_anti")
    return top_of(kept.withColumnRenamed("rank", "place"), ["id"], ["prio", "place"], 1).drop("rank")

"""Streams with state, and tables that take upserts, against plain loops; each is stopped and goes on."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from brackwater.operators.versioned import VersionedTable, cleared
from brackwater.session import new_folder
from brackwater.streaming import state

START = dt.datetime(2024, 1, 1)


def coming(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
    return state.incoming(spark, folder, spark.createDataFrame([], schema).schema)


def test_changes_of_scans_and_restart(spark):
    """Four scans, one of them twice, with a directory of a third of all paths that comes and goes."""
    rng = random.Random(1)
    scans = []
    for k in range(4):
        files = {f"d{n % 5}/f{n}": rng.choice("ab") for n in range(40) if rng.random() < 0.8} | ({f"hot/f{n}": "x" for n in range(20)} if k in (0, 2) else {})
        scans.append(files | {"null": None})
    root = new_folder(spark, "changes")
    for k in (0, 1, 1, 2, 3):
        stream = coming(spark, f"{root}/in", [(p, h, START + dt.timedelta(hours=k)) for p, h in scans[k].items()] + [(None, "x", START + dt.timedelta(hours=k))], "path string, hash string, scanned_at timestamp")
        out = state.continued(state.file_changes(stream), f"{root}/out")
    want, known = [], {}
    for files in scans:
        want += [(p, "new" if p not in known else "modified") for p, h in files.items() if p not in known or known[p] != h] + [(p, "deleted") for p in known if p not in files]
        known = files
    got = sorted((r["path"], r["change"]) for r in out.collect())
    assert got == sorted(want)
    again = state.continued(state.file_changes(stream), f"{root}/out")
    assert sorted((r["path"], r["change"]) for r in again.collect()) == got


def test_paths_share_the_states_of_parts(spark, monkeypatch):
    """Four hundred paths in three parts: three states, and the changes of a loop over two scans and a third that holds one path only."""
    monkeypatch.setattr(state, "PARTS", 3)
    scans = [{f"p{n}": None if n % 11 == 0 else "a" for n in range(400) if n % 4}, {f"p{n}": "b" if n % 7 == 0 else None if n % 11 == 0 else "a" for n in range(400) if n % 5}, {"p1": "c"}]
    root, want, known = new_folder(spark, "parts"), [], {}
    for k, files in enumerate(scans):
        stream = coming(spark, f"{root}/in", [(p, h, START + dt.timedelta(hours=k)) for p, h in files.items()], "path string, hash string, scanned_at timestamp")
        out = state.continued(state.file_changes(stream), f"{root}/out")
        at = int((START + dt.timedelta(hours=k) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        want += [(p, "new" if p not in known else "modified", at) for p, h in files.items() if p not in known or known[p] != h] + [(p, "deleted", at - 3_600_000_000) for p in known if p not in files]
        known = files
        if k == 1:
            states = spark.read.format("statestore").option("stateVarName", "last").load(f"{root}/out/checkpoint").count()
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert states == 3


def test_cache_equals_a_loop(spark):
    """Lookups over a day in two batches; a third of them ask for one key."""
    rng = random.Random(2)
    rows = sorted({(START + dt.timedelta(seconds=rng.randrange(40_000), milliseconds=rng.randrange(1000)), rng.choice(["hot", "hot", "a", "b", "c", None, "d"])) for _ in range(900)}, key=lambda r: r[0])
    rows += [(rows[-1][0] + dt.timedelta(seconds=s), "edge") for s in (0, 3599.999999, 3600, 7199, 7200)]
    root = new_folder(spark, "cache")
    for part in (rows[:500], rows[500:]):
        first = rows.index(part[0])
        stream = coming(spark, f"{root}/in", [(k, t, first + j) for j, (t, k) in enumerate(part)], "key string, ts timestamp, number long")
        out = state.continued(state.timed_cache(stream), f"{root}/out")
    stored, want = {}, []
    for number, (t, k) in enumerate(rows):
        hit = k in stored and t < stored[k] + dt.timedelta(seconds=3600)
        if not hit:
            stored[k] = t
        want.append((k, number, hit))
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == want


def test_late_rows_count_within_the_watermark(spark):
    root = new_folder(spark, "rolling")
    at = lambda h: START + dt.timedelta(hours=h)
    batches = [[(at(10), "a", 1.0), (at(10.5), "b", 2.0)], [(at(9), "a", 10.0), (at(14), "a", 4.0)], [(at(12.5), "a", 5.0), (at(2), "a", 100.0), (at(15), "b", 1.0)]]
    seen, outs = [], None
    for batch in batches:
        stream = coming(spark, f"{root}/in", batch, "ts timestamp, agent string, value double")
        rows = state.rolling(stream, [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")], keys=("agent",), length="4 hours", slide="1 hour")
        outs = state.continued(rows, f"{root}/out", keys=["window_end", "agent"])
    seen = [r for b in batches for r in b if r[0] != at(2)]  # 12 hours late: the watermark is at 12
    ends = [at(h) for h in range(8, 24)]
    want = {(e, a): (len(v), sum(v)) for e in ends for a in "ab" if (v := [x for t, g, x in seen if g == a and e - dt.timedelta(hours=4) <= t < e])}
    assert {(r["window_end"], r["agent"]): (r["n"], r["total"]) for r in outs.collect()} == want


def test_counters_run_on(spark):
    root = new_folder(spark, "counters")
    rng, total = random.Random(3), {}
    for _ in range(3):
        batch = [(rng.choice(["hot", "hot", "a", "b"]), rng.randrange(10)) for _ in range(50)]
        for k, v in batch:
            n, s = total.get(k, (0, 0))
            total[k] = (n + 1, s + v)
        stream = coming(spark, f"{root}/in", batch, "store string, ms long")
        out = state.continued(state.counters(stream, [F.count(F.lit(1)).alias("ops"), F.sum("ms").alias("ms")], ("store",)), f"{root}/out", keys=["store"])
        assert {r["store"]: (r["ops"], r["ms"]) for r in out.collect()} == total


def test_sessions_over_two_batches_come_out_once(spark):
    root = new_folder(spark, "log")
    at = lambda m: START + dt.timedelta(minutes=m)
    first = [(0, "u"), (20, "u"), (25, "hot"), *[(25 + k / 10, "hot") for k in range(200)]]
    second = [(45, "u"), (200, "u"), (210, "v"), (400, "end")]
    for part in (first, second):
        spark.createDataFrame([(f"{at(m).isoformat()} {w} did",) for m, w in part] + [("no line of that kind",), ("2024-99-99T00:00:00 x did",)], "value string").coalesce(1).write.mode("append").text(f"{root}/in")
        lines = state.incoming(spark, f"{root}/in", "value string", "text")
        out = state.continued(state.sessions(lines, r"^(\S+) (\w+) did$"), f"{root}/out")
    got = sorted((r["who"], r["start"], r["end"], r["lines"]) for r in out.collect())
    assert got == sorted([("u", at(0), at(45), 3), ("hot", at(25), at(25 + 199 / 10), 201), ("u", at(200), at(200), 1), ("v", at(210), at(210), 1)])


@pytest.mark.parametrize("compacting", [(), (1, 3), (0, 1, 2, 3, 4)])
def test_upserts_into_a_table(spark, compacting):
    """Five batches with repeats, a hot key, null keys and older rows; the last one is taken in twice."""
    rng = random.Random(4)
    schema = spark.createDataFrame([], "id string, seq long, name string").schema
    held = VersionedTable(spark, new_folder(spark, "table"), schema, ranges=8)
    best = {}
    for number in range(5):
        batch = [(rng.choice(["hot", "hot", "hot", None, *"abcdefghij"]), rng.randrange(30), f"{number}-{k}") for k in range(40)]
        batch = list({(i, s): (i, s, n) for i, s, n in batch}.values())
        for i, s, n in batch:
            if i not in best or s >= best[i][1]:
                best[i] = (i, s, n)
        for _ in range(2 if number == 4 else 1):
            held.put(spark.createDataFrame(batch, schema), number)
        if number in compacting:
            assert held.compact() and held.compact() == []
            held.put(spark.createDataFrame([("a", 10**6, "replayed")], schema), number)  # a batch that is in already
        assert {r["id"]: tuple(r) for r in held.read().collect()} == best
    assert held.clear(name=best["hot"][2]) == {"removed": 1, "left": len(best) - 1}
    assert {r["id"] for r in held.read().collect()} == set(best) - {"hot"}
    assert held.clear() == {"removed": len(best) - 1, "left": 0} and held.read().count() == 0
    held.put(spark.createDataFrame([("z", 1, "after")], schema), 9)
    assert [tuple(r) for r in held.read().collect()] == [("z", 1, "after")]


def test_compaction_rewrites_touched_ranges_only(spark):
    import glob
    import os

    schema = spark.createDataFrame([], "id string, seq long").schema
    path = new_folder(spark, "touched")
    held = VersionedTable(spark, path, schema, ranges=16)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/rows/*/*/*.parquet")}
    held.put(spark.range(500).selectExpr("cast(id as string) id", "id as seq"), 0)
    assert len(held.compact()) == 16
    before = files()
    held.put(spark.createDataFrame([("7", 10**6)], schema), 1)
    touched = held.compact()
    after = files()
    assert len(touched) == 1 and len(set(before) - set(after)) == len(set(after) - set(before)) == 1
    assert held.read().count() == 500 and held.read().filter("id = '7'").first()["seq"] == 10**6


def test_clearing_says_what_failed(spark):
    schema = spark.createDataFrame([], "id string, seq long").schema
    good = VersionedTable(spark, new_folder(spark, "good"), schema)
    good.put(spark.createDataFrame([("a", 1), ("b", 1)], schema), 0)
    bad = VersionedTable(spark, "nofilesystem://x/y", schema)
    rows = {r["store"]: tuple(r)[1:] for r in cleared(spark, {"bad": bad, "good": good}).collect()}
    assert rows["good"] == ("success", 2, 0) and rows["bad"][0].startswith("failed") and rows["bad"][2] is None


def test_trees_are_compared_from_the_top(spark):
    """A third of all files in one directory; one changed file opens its directories only, and trees of all kinds equal the full comparison."""
    from brackwater.sources import files

    one = {f"a/hot/f{k}": "x" for k in range(200)} | {f"d{k % 20}/e{k % 3}/f{k}": "x" for k in range(400)}
    table = lambda t: spark.createDataFrame(sorted(t.items()), "path string, hash string")
    old = files.stored_tree(table(one))
    changes, looked = files.changed_below(old, files.stored_tree(table(one | {"d7/e1/f7": "y"})))
    assert [tuple(r) for r in changes.collect()] == [("d7/e1/f7", "modified")]
    assert looked[0] == 1 and sum(looked) < 50
    assert files.changed_below(old, old) == (changes.limit(0), [1]) or files.changed_below(old, old)[1] == [1]
    rng = random.Random(8)
    for _ in range(3):
        two = {p: rng.choice("xxxxy") for p in one if rng.random() < 0.95} | {"new/er/f": "n", "d1": "file now"} | {"a/hot/f3/was/file": "x"}
        two = {p: h for p, h in two.items() if not p.startswith("d1/") and p != "a/hot/f3"}
        got = sorted(map(tuple, files.changed_below(old, files.stored_tree(table(two)))[0].collect()))
        assert got == sorted((p, "deleted" if p not in two else "new" if p not in one else "modified") for p in {*one, *two} if one.get(p) != two.get(p))
    empty = files.stored_tree(spark.createDataFrame([], "path string, hash string"))
    assert {r["change"] for r in files.changed_below(empty, old)[0].collect()} == {"new"} and files.changed_below(empty, empty)[0].collect() == []

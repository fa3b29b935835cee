import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from brackwater.llm import packing, pii, queries

# The base patterns as the contract states them.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), ("email", "ip", "card", "phone").index(kind), kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def odd_texts():
    rng = random.Random(3)
    yield from (None, "", " ", "a@b.c_x@d.e", "x@y.z@w.v.u", "1.2.3.4.5.6.7.8", "001.002.003.0255 256.1.1.1", "\U0001f600 a@b.co \U0001f600 +1 (555) 010-9999 é 4111 1111 1111 1111", "+1+22+333 444 555 666", "4111-1111-1111-1111 0000 0000 0000", "9" * 30000, "a" * 30000, "1.1" * 5000, "+1" + " " * 9000, "a.b" * 8000 + "@c.d", "a@b" + ".c" * 1000, "x a@b" + ".c" * 100_000 + " y", "a [at] b" + " [dot] c" * 20_000, "key " + "ab12" * 10)
    for _ in range(300):
        yield "".join(rng.choice(["a", "Z", "1", "23", "4567", ".", "@", "-", "+", " ", "_", "(", ")", "\n", "é", "com", "255", "4111111111111111"]) for _ in range(rng.randrange(1, 60)))


def test_base_spans_match_the_patterns(spark, sf_dir):
    texts = list(odd_texts())
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, pii string").repartition(4)
    rows = pii.find(df).select("doc_id", pii.listed(F.col("pii.base")).alias("base"), pii.listed(F.col("pii.spans")).alias("spans")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["base"] == ",".join(base(texts[r["doc_id"]])), texts[r["doc_id"]]
        assert set(r["base"].split(",")) - {""} <= set(r["spans"].split(","))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op1_pii(spark, sf_dir).collect():
        want = base(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert Counter(x.split(":")[0] for x in want) == +Counter({k: r[f"n_{k}"] for k in pii.BASE})
    assert pii.find(df.limit(0)).count() == 0


def test_trees_add_other_kinds_and_leave_prose(spark):
    texts = [
        'the token = "11acdfb36bb72224148e6160f674b4be45601bff" ends',
        "pay to IBAN DE89370400440532013000 now",
        "my ssn 123-45-6789 and call (555) 123-4567 or write jane [at] example [dot] org",
        "plain thththththththththththth prose with inananananananananananananana words and 12 numbers",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.find(df).select("doc_id", pii.listed(F.col("pii.spans")).alias("s")).collect()}
    assert got[0] == "secret:13:53" and got[1].startswith("iban:12:") and got[3] == ""
    assert {x.split(":")[0] for x in got[2].split(",")} == {"ssn", "local_phone", "masked_email"}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[0] == 'the token = "[SECRET]" ends' and clean[3] == texts[3]
    two = pii.redact(spark.createDataFrame([(1, "x 4111 1111 1111 1111 y a@b.co", 9), (2, None, None)], "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert "4111" not in two[0]["text"] and two[0]["text"].endswith("y [EMAIL]") and two[0]["n_chars"] == len(two[0]["text"]) and two[1]["text"] is None
    own = spark.createDataFrame([(1, "to a@b.co", "mine", "too")], "doc_id long, text string, pii string, _pii string")
    assert tuple(pii.redact(own).first()) == (1, "to [EMAIL]", "mine", "too")


def test_long_and_named_secrets(spark):
    """Tokens of any length, and tokens behind a name and an equals sign, with or without the name."""
    rng = random.Random(7)
    token = lambda n: "".join(rng.choice("ABCDEFGHJKMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz23456789") for _ in range(n))
    keys = [token(n) for n in (129, 300, 5_000)]
    named = [token(32), token(32), token(40)]
    texts = [f'token = "{k}" ends' for k in keys] + [f"bearer {k} ends" for k in keys] + [f"{n}{k} and more of it." for n, k in zip(("api_key=", "the secret_token=", "export AUTH_KEY="), named)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.find(df).select("doc_id", pii.listed(F.col("pii.spans")).alias("s")).collect()}
    for k, t in enumerate(texts):
        key = (keys * 2 + named)[k]
        start, end = t.index(key), t.index(key) + len(key)
        run = t.rindex(" ", 0, start) + 1 if " " in t[:start] and k > 6 else start
        assert got[k] in (f"secret:{start}:{end}", f"secret:{run}:{end}"), (t[:40], got[k])
    assert got[6] == "secret:8:40"
    learned = pii.training(spark, 10, 3).filter("name = 'secret' and truth = 1").withColumn("c", pii.candidates(F.col("text")))
    assert learned.filter(~F.exists("c", lambda c: (c["start"] == F.col("start")) & (c["kind"] == pii.KINDS.index("secret")))).count() == 0


def test_boundaries_are_the_best():
    from itertools import combinations

    rng = random.Random(1)
    for _ in range(20):
        x = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        c = [rng.randrange(1, 9) for _ in x]
        cost = lambda ends: sum(n * (min(e for e in ends if e >= v) - v) for v, n in zip(x, c))
        for b in (1, 2, 3):
            best = min(cost([*s, x[-1]]) for k in range(min(b, len(x))) for s in combinations(x[:-1], k))
            ends = packing.boundaries(x, c, b)
            assert len(ends) <= b and ends[-1] == x[-1] and cost(ends) == best
    assert packing.boundaries([], [], 4) == []


def test_long_texts_do_not_blur_the_ends(spark):
    """One text of 20,001 tokens leaves the other lengths as they are: every bucket ends at the longest text in it, with the least padding."""
    lengths = [1_025, 1_031, 1_033, 1_100, 1_101, 1_777, 20_001]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, n long")
    got = packing.pack(df, buckets=7, length=F.col("n")).collect()
    assert len(got) == 7 and all(r["padding"] == 0 for r in got)
    got = packing.pack(df, buckets=4, length=F.col("n")).collect()
    assert sum(r["padding"] for r in got) == 8 + 2 + 1 and {r["bucket_length"] for r in got} == {1_033, 1_101, 1_777, 20_001}
    ends = {b: max(r["n_tokens"] for r in got if r["bucket"] == b) for b in {r["bucket"] for r in got}}
    assert all(ends[r["bucket"]] == r["bucket_length"] for r in got)


def test_batches_hold_every_document_once(spark, sf_dir):
    out = queries.op3_packing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    sizes, places = Counter(), Counter()
    for r in out:
        assert r["padding"] == r["bucket_length"] - r["n_tokens"] >= 0
        sizes[r["batch"], r["bucket_length"]] += 1
        places[r["batch"], r["place"]] += 1
    assert max(places.values()) == 1 and all(n == 1 or n * length <= 32_768 for (_, length), n in sizes.items())
    short = Counter(b.split("-")[0] for (b, length), n in sizes.items() if n < max(1, 32_768 // length))
    assert max(short.values()) == 1
    again = packing.pack(docs.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    odd = spark.createDataFrame([(None, None, 1), (2, "", 1), (2, "", 1), (3, "w " * 90_000, 1)], "doc_id long, text string, bucket int")
    got = packing.pack(odd, bins=64, buckets=2).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 1, 90_001] and all(r["padding"] >= 0 for r in got)
    assert packing.pack(odd.limit(0)).count() == 0


def test_many_like_rows_are_dealt(spark, monkeypatch):
    """A third of all rows alike in id and length: their numbers are dealt over tasks, and nothing else moves."""
    monkeypatch.setattr(packing, "CHUNK", 40)
    rows = [(None, 7)] * 300 + [(k, 5 + k % 9) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, n long").repartition(5)
    pack = lambda d: packing.pack(d, buckets=2, token_budget=64, length=F.col("n")).collect()
    out = pack(df)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == Counter(rows)
    full = Counter(r["batch"] for r in out)
    for b in {r["bucket"] for r in out}:
        each = {r["bucket_length"]: max(1, 64 // r["bucket_length"]) for r in out if r["bucket"] == b}
        sizes = [n for name, n in full.items() if name.startswith(f"{b}-")]
        assert sum(n < max(each.values()) for n in sizes) <= 1 and max(Counter((r["batch"], r["place"]) for r in out).values()) == 1
    assert sorted(map(tuple, pack(df.repartition(3))), key=str) == sorted(map(tuple, out), key=str)


def test_very_many_spans_in_one_text(spark):
    """100,000 spans in one text: base ones, further ones between and under them. All are found and redacted, in time that follows the text."""
    import time

    one = "mail a@b.co or write to john [at] example [dot] com now, from 10.0.0.1 é "
    took = {}
    for n in (4_000, 34_000):
        df = spark.createDataFrame([(1, one * n)], "doc_id long, text string")
        began = time.time()
        r = pii.find(df).selectExpr("size(pii.base) b", "size(pii.spans) s", "pii.spans[3 * 100].start at").first()
        assert (r["b"], r["s"]) == (2 * n, 3 * n) and r["at"] == 100 * len(one) + 5
        redacted = pii.redact(df).first()["text"]
        assert redacted == "mail [EMAIL] or write to [MASKED_EMAIL] now, from [IP] é " * n
        took[n] = time.time() - began
    assert took[34_000] < 25 * took[4_000]

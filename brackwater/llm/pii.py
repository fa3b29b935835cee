"""Personal data by candidate gradient boosting, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of, unused

# The base patterns in a form that never runs over the same characters twice. A run of characters that can begin a match is
# only tried from its start, or from where the last match ended; runs are possessive where nothing that follows could take back a character.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Further generators, of high recall: what they propose is up to the trees.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){3,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])[A-Za-z0-9+/_=-]{20,}+"
# The part of such a run that stands behind a name and an equals sign, proposed besides the run; equals signs that end the run belong to it.
NAMED_SECRET = r"(?<==)[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+(-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
MASKED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[\x20]?(?:\[at\]|\(at\)|@)[\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?(?:\[dot\]|\(dot\)|\.)[\x20]?[A-Za-z0-9-]{1,63}){1,16}"

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn", "local_phone", "masked_email")
GENERATORS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, IBAN, SECRET, SSN, LOCAL_PHONE, MASKED_EMAIL), strict=True))
CONTEXT = 24
CUE = r"(?i)(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|account|iban|bank|ssn|social|token|secret|passw|key|bearer|auth|\bip\b|host|address)"


def running(values: Column, merge=lambda a, b: a + b, chunk: int = 256) -> Column:
    """Sums (or maxima) up to and including each of an array's whole numbers, none below 0. Inside chunks first and then over the chunks, so that long arrays are not copied for each element."""

    def sums(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: let(merge(a["at"], x), lambda y: F.struct(y.alias("at"), F.concat(a["out"], F.array(y)).alias("out")))
        return F.aggregate(xs, start, step, lambda a: a["out"])

    def joined(parts: Column) -> Column:
        ends = sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: merge(x, F.coalesce(F.get(e, i - 1), F.lit(0)))))))

    some = lambda v: let(chunks(v, chunk), lambda c: let(F.transform(c, sums), joined))
    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(some(v)))


def chunks(values: Column, chunk: int = 256) -> Column:
    """An array as an array of arrays of at most `chunk` elements."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(chunk)), lambda k: F.slice(values, k, chunk))


def folded(values: Column, start: Column, kind: str, step, done) -> Column:
    """An aggregate over an array whose step gives (state, element or null): done(state, elements). Elements are gathered chunk by chunk, so that they are not copied again for each."""

    def inside(state: Column, part: Column) -> Column:
        begin = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))

        def one(a: Column, x: Column) -> Column:
            state, element = step(a["state"], x)
            return F.struct(state.alias("state"), F.when(element.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(element))).alias("out"))

        return F.aggregate(part, begin, one)

    begin = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    over = lambda a, part: let(inside(a["state"], part), lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out")))
    return F.aggregate(chunks(values), begin, over, lambda a: done(a["state"], F.flatten(a["out"])))


def matches(text: Column, kind: int, pattern: str, tried: Column | None) -> Column:
    """array(struct(start, kind, end, found, ahead)) of the pattern's leftmost matches, in code points: each starts after all gaps and matches before it. ahead: the CONTEXT code points before it, of kinds that have features."""

    def before(found: Column, gaps: Column, i: Column) -> Column:
        # Matches of these kinds have five characters at least, so five of them and the gaps between hold the context.
        parts = [F.coalesce(x, F.lit("")) for k in range(5, 0, -1) for x in (F.get(found, i - k), F.get(gaps, i - k + 1))]
        return F.right(F.concat(F.when(i.between(1, 5), F.get(gaps, F.lit(0))).otherwise(""), *parts), F.lit(CONTEXT))

    def placed(found: Column) -> Column:
        def ends(g: Column) -> Column:
            one = lambda e: F.transform(found, lambda f, i: F.struct((F.get(e, i) - F.length(f)).alias("start"), F.lit(kind).alias("kind"), F.get(e, i).alias("end"), f.alias("found"), (before(found, g, i) if kind >= len(BASE) else F.lit(None).cast("string")).alias("ahead")))
            return let(running(F.transform(found, lambda f, i: F.length(F.get(g, i)) + F.length(f))), one)

        return let(F.split(text, pattern, -1), ends)

    none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string,ahead:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if tried is not None:
        found = F.when(tried, found).otherwise(F.array().cast("array<string>"))
    return let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(placed(f)))


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int") * (i % 2 + 1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """An IBAN's check: its letters as numbers from 10, read modulo 97 from the fifth character round to the fourth."""
    turned = F.concat(F.substring(account, F.lit(5), F.lit(64)), F.substring(account, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("string").try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)) == 1


def valid(kind: Column, found: Column) -> Column:
    """Whether a match passes its kind's own rule; kinds without one always do."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    part = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda t: F.when(F.length(t) <= 3, F.coalesce(t.try_cast("int"), F.lit(0)) <= 255).otherwise(False))
    name = lambda k: kind == KINDS.index(k)
    return (
        F.when(name("ip"), F.forall(F.split(found, r"\."), part))
        .when(name("card"), let(digits, lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)))
        .when(name("phone"), F.length(digits).between(9, 15))
        .when(name("iban"), let(F.regexp_replace(found, " ", ""), lambda t: F.when(F.length(t).between(15, 34), mod97(t)).otherwise(False)))
        .when(name("ssn"), ~found.rlike("^(000|666|9..)-|-00-|-0000$"))
        .otherwise(True)
    )


def candidates(text: Column) -> Column:
    """All that the generators propose, overlaps included: array(struct(start, kind, end, found))."""
    digits = text.rlike("[0-9]{3}")
    tried = {"email": text.contains("@"), "ip": text.contains("."), "phone": text.contains("+"), "ssn": digits, "local_phone": digits, "masked_email": text.rlike(r"@|\[at\]|\(at\)")}
    named = matches(text, KINDS.index("secret"), NAMED_SECRET, text.contains("="))
    return F.concat(*[matches(text, k, GENERATORS[name], tried.get(name)) for k, name in enumerate(KINDS)], named)


FEATURES = ("kind", "length", "digits", "variety", "mixed", "cases", "cue", "before", "valid", "breaks")


def features(c: Column) -> Column:
    """Format and context of a candidate in small whole numbers."""
    n = c["end"] - c["start"]
    share = lambda pattern: (8 * F.length(F.regexp_replace(c["found"], pattern, "")) / n).cast("int")
    ahead, last = c["ahead"], F.right(c["ahead"], F.lit(1))
    return F.struct(
        c["kind"].alias("kind"),
        F.least(F.floor(n / 4), F.lit(15)).cast("int").alias("length"),
        share("[^0-9]+").alias("digits"),
        (8 * F.size(F.array_distinct(F.split(c["found"], ""))) / n).cast("int").alias("variety"),
        (c["found"].rlike("[0-9]") & c["found"].rlike("[A-Za-z]")).cast("int").alias("mixed"),
        (c["found"].rlike("[A-Z]").cast("int") + 2 * c["found"].rlike("[a-z]").cast("int")).alias("cases"),
        ahead.rlike(CUE).cast("int").alias("cue"),
        F.when(last.rlike("[\"']"), 1).when(last.rlike("[=:]"), 2).when(last.rlike("^$|[\x20\x09-\x0D(]"), 0).otherwise(3).alias("before"),
        valid(c["kind"], c["found"]).cast("int").alias("valid"),
        F.least(F.length(F.regexp_replace(c["found"], "[A-Za-z0-9]+", "")), F.lit(7)).alias("breaks"),
    )


def boosted(rows: list, truth: list[float], weight: list[float], *, rounds: int, depth: int, rate: float):
    """Gradient boosting of logistic loss over distinct feature rows with weights: a list of trees, each a leaf value or (feature, most, left, right)."""
    score = [0.0] * len(rows)
    trees = []

    def grow(at: list[int], left: int, g: list[float], h: list[float]):
        sum_g, sum_h = sum(g[i] for i in at), sum(h[i] for i in at)
        leaf = rate * sum_g / (sum_h + 1.0)
        best = (1e-6, None, None)
        if left:
            for f in range(len(FEATURES)):
                by: dict[int, list[float]] = {}
                for i in at:
                    x = by.setdefault(rows[i][f], [0.0, 0.0])
                    x[0] += g[i]
                    x[1] += h[i]
                lg = lh = 0.0
                for v in sorted(by)[:-1]:
                    lg, lh = lg + by[v][0], lh + by[v][1]
                    gain = lg * lg / (lh + 1) + (sum_g - lg) ** 2 / (sum_h - lh + 1) - sum_g * sum_g / (sum_h + 1)
                    if gain > best[0]:
                        best = (gain, f, v)
        if best[1] is None:
            for i in at:
                score[i] += leaf
            return leaf
        _, f, v = best
        return f, v, grow([i for i in at if rows[i][f] <= v], left - 1, g, h), grow([i for i in at if rows[i][f] > v], left - 1, g, h)

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-x)) for x in score]
        trees.append(grow(list(range(len(rows))), depth, [w * (t - q) for w, t, q in zip(weight, truth, p)], [w * q * (1 - q) for w, q in zip(weight, p)]))
    return trees


def value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def compiled(trees: list, f: Column) -> Column:
    """The trees' summed value as one expression."""
    def one(t):
        return F.when(f[FEATURES[t[0]]] <= t[1], one(t[2])).otherwise(one(t[3])) if isinstance(t, tuple) else F.lit(float(t))

    out = F.lit(0.0)
    for t in trees:
        out = out + one(t)
    return out


# Templates of training spans. # is a digit, ~ a hex digit, ? a letter or digit, * a small letter, ^ a capital.
TEMPLATES = (
    (1, "ssn", "my social security number is ", "###-##-####"),
    (1, "ssn", "SSN: ", "###-##-####"),
    (0, "ssn", "part no. ", "000-##-####"),
    (0, "ssn", "serial ", "9##-##-0000"),
    (1, "local_phone", "call me at ", "(###) ###-####"),
    (1, "local_phone", "phone ", "###-###-####"),
    (1, "local_phone", "tel: ", "###.###.####"),
    (1, "local_phone", "reach us on ", "(###) ###-####"),
    (0, "local_phone", "the sum of ", "### ### ####"),
    (0, "local_phone", "values ", "### ### ####"),
    (1, "masked_email", "write to ", "***** [at] ****** [dot] ***"),
    (1, "masked_email", "mail ", "***.****(at)*******.***"),
    (1, "masked_email", "contact ", "****** @ ******.***"),
    (0, "masked_email", "sold ", "## @ #.##"),
    (0, "masked_email", "size ", "# @ ##.#"),
    (1, "secret", 'token = "', "~" * 40),
    (1, "secret", "api_key=", "?" * 32),
    (1, "secret", 'password: "', "?" * 24),
    (1, "secret", "bearer ", "?" * 48),
    (1, "secret", "key ", "~" * 64),
    (1, "secret", "we found ", "~" * 40),
    (0, "secret", "the ", "*" * 20),
    (0, "secret", "of ", "*" * 26),
    (0, "secret", "And ", "^" + "*" * 30),
    (0, "secret", "text ", "-" * 24),
    (0, "secret", "x ", "=" * 40),
    (0, "secret", "AND ", "^" * 22),
    (0, "secret", "in ", "********-********-********"),
    (0, "secret", "see ", "*******/********/*******"),
    (0, "secret", "sum ", "#" * 22),
    (0, "secret", "on ", "*" * 45),
    (0, "secret", "by ", "^" + "*" * 21),
    (0, "iban", "ref ", "^^## #### #### #### #### ##"),
    (0, "iban", "code ", "^^##????############"),
)
# Published example account numbers with right check digits.
ACCOUNTS = ("DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "ES9121000418450200051332", "NL91ABNA0417164300", "IT60X0542811101000000123456", "BE68539007547034", "CH9300762011623852957")


def training(spark, each: int, seed: int) -> DataFrame:
    """each seeded examples of every template: text, start of the span, kind, truth."""
    rows = [(t, k, ahead, shape) for t, k, ahead, shape in TEMPLATES] + [(1, "iban", ahead, a) for a in ACCOUNTS for ahead in ("IBAN ", "pay to account ")]
    df = spark.createDataFrame([(*r, k) for r in rows for k in range(each)], "truth int, name string, ahead string, shape string, k int")
    pick = lambda i, n: F.pmod(F.xxhash64("name", "shape", "ahead", "k", i, F.lit(seed)), F.lit(n)).cast("int")
    of = lambda s, i: F.substring(F.lit(s), pick(i, len(s)) + 1, F.lit(1))
    drawn = lambda c, i: F.when(c == "#", of("0123456789", i)).when(c == "~", of("0123456789abcdef", i)).when(c == "?", of("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789", i)).when(c == "*", of("aehinorstlduc", i)).when(c == "^", of("AEHINORSTLDUC", i)).otherwise(c)
    fixed = F.col("name").eqNullSafe("iban") & (F.col("truth") == 1)
    span = F.when(fixed, F.col("shape")).otherwise(F.array_join(F.transform(F.split("shape", ""), lambda c, i: drawn(c, i)), ""))
    return df.select("truth", "name", "k", F.length("ahead").alias("start"), F.concat("ahead", span, F.lit(" and more of it.")).alias("text"))


#: Of each session and its options, what was fitted: the examples are the same each time.
FITTED: dict[tuple, tuple] = {}


def fitted(spark, *, each: int = 40, rounds: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.95, seed: int = 3) -> tuple[list, dict[int, float]]:
    """Boosted trees, and for each kind the threshold, midway between held-out scores, above which examples are right as often as `precision` asks.

    They learn from seeded examples of fixed templates, `each` of a template, half of them held out for the thresholds.
    """
    key = (spark.sparkContext.applicationId, each, rounds, depth, rate, precision, seed)
    if key in FITTED:
        return FITTED[key]
    texts = training(spark, each, seed).withColumn("c", candidates(F.col("text")))
    rows = texts.select("truth", "name", "start", "k", F.explode(F.transform("c", lambda c: F.struct(c["start"].alias("at"), features(c).alias("f")))).alias("c"))
    rows = rows.filter(F.col("c.f.kind") >= len(BASE))
    kind = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(KINDS) for x in (n, k)]), F.col("name"))
    hit = (F.col("truth") == 1) & (F.abs(F.col("c.at") - F.col("start")) <= 1) & (kind == F.col("c.f.kind"))
    counts = rows.groupBy((F.col("k") % 2).alias("held"), *[F.col(f"c.f.{n}").alias(n) for n in FEATURES]).agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("int")).alias("good")).collect()
    split = lambda held: [(tuple(r[n] for n in FEATURES), y, w) for r in sorted(counts, key=tuple) if r["held"] == held for y, w in ((1.0, r["good"]), (0.0, r["n"] - r["good"])) if w]
    own, held = split(0), split(1)
    trees = boosted([r for r, _, _ in own], [y for _, y, _ in own], [float(w) for _, _, w in own], rounds=rounds, depth=depth, rate=rate)
    least = {}
    for k in range(len(BASE), len(KINDS)):
        scored = sorted(((sum(value(t, r) for t in trees), y, w) for r, y, w in held if r[0] == k), reverse=True)
        right = total = 0.0
        for j, (x, y, w) in enumerate(scored):
            right, total = right + y * w, total + w
            if right >= precision * total and (j + 1 == len(scored) or scored[j + 1][0] < x):
                below = scored[j + 1][0] if j + 1 < len(scored) else min(x, 0.0) - 1.0
                least[k] = (x + below) / 2
    FITTED[key] = trees, least
    return trees, least


def find(docs: DataFrame, *, text_column: str = "text", column: str = "pii", **options) -> DataFrame:
    """docs with `column`, struct(base, spans): arrays of struct(start, kind, end) in code points, end exclusive, by start, then kind.

    base holds every match of the four base patterns that passes its kind's rule, overlaps between kinds included. spans adds those
    candidates of the further generators whose boosted score reaches their kind's threshold, unless they overlap a base span or a further
    one that starts before them. Null texts are empty and have no spans; repeated rows have the same ones. Other columns pass
    through; one of that name is replaced.
    """
    trees, least = fitted(docs.sparkSession, **options)
    text = text_of(text_column)
    short = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    out = docs.withColumn(column, candidates(text))
    sure = F.filter(column, lambda c: (c["kind"] < len(BASE)) & valid(c["kind"], c["found"]))
    more = F.filter(column, lambda c: c["kind"] >= len(BASE))
    floors = [least.get(k, math.inf) for k in range(len(KINDS))]
    floor = lambda k: F.element_at(F.array(*[F.lit(x) for x in floors]), k + 1)
    chosen = F.filter(more, lambda c: let(features(c), lambda f: compiled(trees, f)) >= floor(c["kind"]))
    out = out.withColumn(column, F.struct(F.array_sort(F.transform(sure, short)).alias("base"), F.array_sort(F.transform(chosen, short)).alias("more")))

    # Bound once: a column that a lambda names would be worked out again for each element.
    return out.withColumn(column, let(F.col(column), lambda v: F.struct(v["base"].alias("base"), F.array_sort(F.concat(v["base"], _apart(_free(v["more"], v["base"])))).alias("spans"))))


def _free(more: Column, base: Column) -> Column:
    """Those that overlap no base span: of the base spans that start before one's end, found by halving, none ends after its start."""

    def covered(c: Column, highest: Column) -> Column:
        half = lambda a: F.floor((a["low"] + a["high"]) / 2).cast("int")
        start = F.struct(F.lit(0).alias("low"), F.size(base).alias("high"))
        below = lambda a: F.get(base, half(a))["start"] < c["end"]
        step = lambda a, _: F.when(a["low"] >= a["high"], a).when(below(a), F.struct((half(a) + 1).alias("low"), a["high"].alias("high"))).otherwise(F.struct(a["low"].alias("low"), half(a).alias("high")))
        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(base) + 1)).cast("int")), start, step, lambda a: F.coalesce(F.get(highest, a["low"] - 1) > c["start"], F.lit(False)))

    kept = let(running(F.transform(base, lambda b: b["end"]), F.greatest), lambda h: F.filter(more, lambda c: ~covered(c, h)))
    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(kept)


def _apart(more: Column) -> Column:
    """Of those that overlap each other, the first, and so on."""
    kept = lambda end, c: (F.when(c["start"] >= end, c["end"]).otherwise(end), F.when(c["start"] >= end, c))
    return let(more, lambda m: folded(m, F.lit(0), "struct<start:int,kind:int,end:int>", kept, lambda _, out: out))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with each found span of `text` replaced by its kind in brackets, overlapping ones as one; n_chars follows where docs have it.

    Texts without a span, null ones among them, stay as they are, and so do all other columns, whatever their names.
    """
    own = unused(docs, "pii")
    found = find(docs, column=own, **options)
    spans = F.col(f"{own}.spans")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = text_of()

    block = 1024

    def merged(spans: Column) -> Column:
        """The text with spans that overlap as one. Its parts are looked for in blocks, so that no part is counted from the text's start."""
        kind = "struct<from:int,to:int,kind:int>"
        kept = lambda end, c: (F.greatest(end, c["end"]), F.when(c["start"] >= end, F.struct(end.alias("from"), c["start"].alias("to"), c["kind"].alias("kind"))))

        def joined(blocks: Column) -> Column:
            def part(start: Column, end: Column) -> Column:
                first = F.floor(start / block).cast("int")
                some = F.slice(blocks, first + 1, F.floor((end - 1) / block).cast("int") - first + 1)
                return F.when(end > start, F.substring(F.array_join(some, ""), start - first * block + 1, end - start)).otherwise("")

            names_ = lambda out: F.array_join(F.transform(out, lambda s: F.concat(part(s["from"], s["to"]), F.element_at(names, s["kind"] + 1))), "")
            return folded(spans, F.lit(0), kind, kept, lambda end, out: F.concat(names_(out), part(end, F.length(text))))

        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), joined)

    out = found.withColumn("text", F.when(F.size(spans) > 0, let(spans, merged)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

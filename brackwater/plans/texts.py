"""Text features, analytics and scorecards over source code made from the documents' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code_text as C
from ..operators.presentation import shortened
from ..session import table
from .registry import query

#: Pieces of code; a document's source holds the pieces whose bits its scrambled key has.
PIECES = (
    "import java.util.List;\nimport static org.junit.Assert.assertTrue;\n@Autowired private OrderRepository repository;",
    "public int total(List<Order> orders) {\n  int sum = 0;\n  for (Order o : orders) { if (o != null && (o.size() > 0 || o.isOpen())) { sum += o.price(); } else { sum -= 1; } }\n  return sum;\n}",
    "if (x > 0) { while (x < 10) { x = x / 2; } } else if (x == 0) { throw new IllegalStateException(\"zero\"); }",
    "switch (kind) { case A: return 1; case B: return 2; default: return kind == null ? 0 : 3; }",
    "try { String raw = Files.readString(path); logger.log(raw.substring(2)); } catch (IOException e) { throw e; }",
    "String home = System.getenv(\"HOME\"); Service s = new Service(home); s.save(entity); repository.findById(id);",
    "items.stream().map(i -> i.name()).filter(n -> n.length() > 3).forEach(out::add); CompletableFuture.runAsync(job);",
    "int[] a = new int[Integer.MAX_VALUE]; for(int i=0;i<a.length;i++){ a[i] = a[i] / 3; { { } } }",
    "response = restTemplate.get(url); if (response instanceof Page) { cache.put(key, (Page) response); }",
    "${greeting} <% out.print(user) %> ${name} and ${greeting}; // a note { \"level\": 3 }",
)
TEST_PIECES = (
    "package com.acme;\nimport org.junit.jupiter.api.Test;\nimport static org.mockito.Mockito.*;\nclass OrderTest {",
    "@Test\npublic void should_add_When_empty() { assertEquals(3, total, \"sum is three\"); assertNotNull(list); }",
    "@Test void minimum() { assertThrows(Exception.class, () -> run(null)); }",
    "@Mock Repo repo; @InjectMocks Shop shop; @BeforeEach void init() { when(repo.find(any())).thenReturn(x); verify(repo, times(1)).find(1000); }",
    "// explains\n@Test public int wrong() { return 12345 + 6789 + 1111 + 2222;; }",
    "String env = System.getenv(\"X\"); Object o = new Object(); assertTrue(flag); assertFalse(other);",
    "}",
)


def _made(pieces):
    def build(spark, sf):
        bits = (F.col("doc_id") * 2_654_435_761) % 1_048_576
        chosen = [F.when(F.shiftright(bits, k).bitwiseAND(F.lit(1)) == 1, F.lit(p)) for k, p in enumerate(pieces)]
        return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("\n", *chosen).alias("source"))

    return build


def _made_sql(pieces) -> str:
    bits = "((doc_id * 2654435761) % 1048576)"
    parts = ", ".join("CASE WHEN ({} >> {}) & 1 = 1 THEN '{}' END".format(bits, k, p.replace("'", "''")) for k, p in enumerate(pieces))
    return f"SELECT doc_id AS id, concat_ws(chr(10), {parts}) AS source FROM documents"


sources, tests = _made(PIECES), _made(TEST_PIECES)
S = f"WITH s AS ({_made_sql(PIECES)})"
T = f"WITH s AS ({_made_sql(TEST_PIECES)})"


def n(p: str, any_case: bool = False) -> str:
    return "len(regexp_extract_all(source, '{}{}'))".format("(?i)" if any_case else "", p.replace("'", "''"))


def k(part: str) -> str:
    return f"CAST((length(source) - length(replace(source, '{part}', ''))) // {len(part)} AS INTEGER)"


def has(*parts: str, lower: bool = False) -> str:
    return "(" + " OR ".join(f"contains({'lower(source)' if lower else 'source'}, '{p}')" for p in parts) + ")"


def names(*pairs: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{x}' END" for x, c in pairs) + ")"


CC = "greatest(1, 1 + " + " + ".join(n(p, True) for p in C.DECISIONS) + f" - {n(chr(92) + 'belse' + chr(92) + 's*' + chr(92) + '{', True)})"
BR = "(" + " + ".join(n(p, True) for p in C.BRANCHES) + ")"
#: Depths by recursion over the braces: one that closes too many stays at 0.
DEPTH = "list_reduce(list_prepend({'now': 0, 'most': 0}, list_transform(regexp_extract_all(source, '[{}]'), lambda b: {'now': CASE b WHEN '{' THEN 1 ELSE -1 END, 'most': 0})), lambda a, x: {'now': greatest(0, a.now + x.now), 'most': greatest(a.most, a.now + x.now)}).most"
LEVEL = "CASE WHEN cc <= 5 AND br <= 3 AND depth <= 2 THEN 'Low' WHEN cc <= 10 AND br <= 7 AND depth <= 4 THEN 'Medium' WHEN cc <= 20 AND br <= 15 AND depth <= 6 THEN 'High' ELSE 'Very High' END"
LINES = "len(string_split(source, chr(10)))"
EDGES = names(("null_input", has("null", lower=True)), ("empty_collection", has("empty", "size() == 0", lower=True)), ("numeric_boundary", has("== 0", "> 0", "< 0", "<= 0", ">= 0")), ("string_edge_cases", has("String", "length()", "substring")))
CONCERNS = names(("file_operations", has("File", "Files.", "InputStream", "OutputStream")), ("database_operations", has("Repository", "EntityManager", "save(", "findBy")), ("network_operations", has("HttpClient", "RestTemplate", "WebClient")))
items = lambda x: f"len(list_filter(string_split({x}, ','), lambda x: x <> ''))"
M = f"{S[:-1]}), m AS (SELECT id, source, CAST({CC} AS INTEGER) AS cc, CAST({BR} AS INTEGER) AS br, CAST({DEPTH} AS INTEGER) AS depth FROM s)"


def measured(spark, sf):
    c = F.col("source")
    return sources(spark, sf).select("id", "source", C.cyclomatic(c).alias("cc"), C.branches(c).alias("br"), C.nesting(c).alias("depth"))


def _simple(name: str, sql: str, expression, column: str = "value", base=measured, head: str = M, frm: str = "m"):
    @query(f"{head} SELECT id, {sql} AS {column} FROM {frm}", name)
    def run(spark, sf):
        return base(spark, sf).select("id", expression(F.col("source")).alias(column))


_simple("cyclomatic_complexity", "cc", lambda c: F.col("cc"))
_simple("branch_count", "br", lambda c: F.col("br"))
_simple("nesting_depth", "depth", lambda c: F.col("depth"))
_simple("complexity_level", LEVEL, lambda c: C.level(F.col("cc"), F.col("br"), F.col("depth")))
_simple("complexity_patterns", names(("long", f"{LINES} > 20"), ("deep", "depth > 4"), ("returns", n(r"\breturn\s+") + " > 3"), ("booleans", n(r"\([^)]*(?:&&|\|\|)[^)]*\)") + " > 2")), lambda c: C.complexity_patterns(c, F.col("depth")))
_simple("deep_route", f"(cc > 10 OR br > 7 OR depth > 4 OR {LINES} > 50 OR regexp_matches(source, '{'|'.join(C.DEEP)}'))", lambda c: C.needs_depth(c, F.col("cc"), F.col("br"), F.col("depth")))
_simple("edge_cases", EDGES, C.edge_cases)
_simple("exception_scenarios", names(("explicit_exceptions", has("throw new", "throws")), ("division_by_zero", f"{has('/')} AND {k('/')} <> {k('//')}"), ("array_index_out_of_bounds", f"{has('[')} AND {has(']')}")), C.exception_scenarios)
_simple("boundary_conditions", names(("max_min_values", has("MAX_VALUE", "MIN_VALUE", "Integer.MAX", "Long.MAX")), ("loop_boundaries", has("for(", "while(", "do {"))), C.boundary_conditions)
_simple("resource_concerns", CONCERNS, C.resource_concerns)
_simple("dependency_patterns", names(("injection", has("@Autowired", "@Inject")), ("factory", has("Factory", "Builder")), ("service", has("Service")), ("repository", has("Repository"))), C.dependency_patterns)
# Written from the patterns' definition: nothing here is taken from the module that is checked.
PERFORMANCE = (("Contains loops", "(contains(source, 'for(') OR contains(source, 'while('))"), ("Contains nested loops (O(n²) potential)", f"{k('for(')} + {k('while(')} > 1"), ("Uses Stream API", "(contains(source, 'stream()') OR contains(source, 'forEach') OR contains(source, 'map(') OR contains(source, 'filter('))"), ("Potential recursion", r"regexp_matches(source, '(public|private|protected)?\s*(static)?\s*\w+\s+(\w+)\s*\(')"))
_simple("performance_level", f"CASE WHEN {items(CONCERNS)} > 2 THEN 'High Impact' WHEN {items(CONCERNS)} > 0 OR {' + '.join(f'CAST(({p}) AS INTEGER)' for _, p in PERFORMANCE)} > 2 THEN 'Medium Impact' ELSE 'Low Impact' END", C.performance_level)
_simple("performance_patterns", names(*PERFORMANCE), lambda c: C.named(list(C.performance_patterns(c).items())))
_simple("is_async", "regexp_matches(source, 'CompletableFuture|Future|@Async|async|await|thenApply|thenAccept')", C.is_async)
_simple("recommended_tests", f"CAST(least(15, 3 + CASE WHEN cc > 10 THEN 3 WHEN cc > 5 THEN 2 ELSE 1 END + least({items(EDGES)}, 5)) AS INTEGER)", lambda c: C.recommended_tests(F.col("cc"), C.edge_cases(c)))
_simple("mock_strategy", "CASE WHEN cc > 20 THEN 'comprehensive' WHEN cc > 10 THEN 'moderate' WHEN br > 5 THEN 'focused' ELSE 'minimal' END", lambda c: C.mock_strategy(F.col("cc"), F.col("br")))
joined = lambda a: F.array_join(F.array_sort(a), ",")
_simple("template_vars", r"array_to_string(list_sort(list_distinct(regexp_extract_all(source, '\$\{([^}]+)\}', 1))), ',')", lambda c: joined(C.template_variables(c)))
_simple("template_instantiate", "replace(replace(source, '${greeting}', 'Hi'), '${name}', 'Bo')", lambda c: C.instantiated(c, {"greeting": "Hi", "name": "Bo"}))
_simple("call_names", r"array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(source, '([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*)\s*\(', 1)), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in C.CALL_KEYWORDS) + "))), ',')", lambda c: joined(C.calls(c)))


def _segments(name: str, pattern: str):
    _simple(name, f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(source, '{pattern}', 1), lambda x: string_split(x, '.')[-1]))), ',')", lambda c: joined(C.last_segments(c, pattern)))


_segments("import_connections", r"import\s+(?:static\s+)?([^;]+);")
_segments("annotation_connections", r"@(\w+(?:\.\w+)*)")
_segments("type_connections", r"(?:new\s+|cast\s+|instanceof\s+)(\w+(?:\.\w+)*)")
_simple("extract_json_block", r"regexp_extract(source, '(?s)\{.*\}', 0)", C.json_block)


@query()
def field_usage(spark, sf):
    return sources(spark, sf).select("id", joined(C.fields_used(F.col("source"))).alias("value"))


@query()
def null_safety(spark, sf):
    return sources(spark, sf).select("id", joined(C.null_safety(F.col("source"))).alias("value"))


HIGH_SQL = ", ".join(f"'{c}'" for c in ("database", "network", "environment", "object_creation", "security", "file_system", "io_operations", "reflection", "validation", "serialization", "caching", "messaging"))
DIMENSION = "(SELECT category, CASE WHEN category IN (" + HIGH_SQL + ") THEN 'high' ELSE 'medium' END AS criticality, pattern, '(?i)' || pattern AS p FROM (VALUES " + ", ".join("('{}', '{}')".format(c, p) for c, ps in C.PATTERNS for p in ps) + ") AS v(category, pattern) UNION ALL SELECT category, 'high', pattern, pattern FROM (VALUES " + ", ".join("('{}', '{}')".format(c, p) for c, p in C.SPECIFIC) + ") AS v(category, pattern)) AS d"
MET = f"(SELECT id, category, criticality, pattern, CAST(len(regexp_extract_all(source, p)) AS INTEGER) AS matches FROM s, {DIMENSION})"


@query(f"{S} SELECT * FROM {MET} WHERE matches > 0")
def external_dependencies(spark, sf):
    return C.external_dependencies(sources(spark, sf))


CALLED_SQL = "SELECT id, unnest(list_distinct(regexp_extract_all(source, '([A-Za-z0-9_]+)\\s*\\(', 1))) AS name FROM s"


@query(f"""{S}, c AS ({CALLED_SQL}) SELECT id, name AS what, CASE WHEN regexp_matches(lower(name), 'save|delete|update|create') THEN 'Data modification operation' ELSE 'Validation operation' END AS reason, CASE WHEN regexp_matches(lower(name), 'save|delete|update|create') THEN 'high' ELSE 'medium' END AS criticality FROM c WHERE regexp_matches(lower(name), 'save|delete|update|create|validate|check|verify')
UNION ALL SELECT id, pattern, 'External ' || category || ' dependency', criticality FROM {MET} WHERE matches > 0 AND criticality = 'high'""")
def critical_dependencies(spark, sf):
    rows = sources(spark, sf)
    called = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"([A-Za-z0-9_]+)\s*\("), F.lit(1)))).alias("name"))
    return C.critical_dependencies(called, C.external_dependencies(rows))


# How to stand in for a category.
EXAMPLES = {"database": "@Mock Repository", "network": "@Mock RestTemplate", "file_system": "@TempDir", "environment": "MockedStatic<System>", "object_creation": "mockConstruction", "time": "Clock.fixed"}


@query(f"{S}, e AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EXAMPLES.items()) + f") AS e(category, example)) SELECT DISTINCT id, category, coalesce(example, 'mock(' || category || ')') AS example FROM {MET} LEFT JOIN e USING (category) WHERE matches > 0")
def mock_recommendations(spark, sf):
    examples = spark.createDataFrame(list(EXAMPLES.items()), "category string, example string")
    met = C.external_dependencies(sources(spark, sf)).select("id", "category").distinct()
    return met.join(F.broadcast(examples), "category", "left").select("id", "category", F.coalesce("example", F.concat(F.lit("mock("), "category", F.lit(")"))).alias("example"))


@query("WITH l AS (SELECT doc_id AS id, unnest(string_split('Main.java:' || doc_id || ': error: missing;' || chr(10) || chr(10) || 'note ' || lang || chr(10) || 'warning: unchecked', chr(10))) AS line FROM documents) SELECT id, line, CASE WHEN contains(line, 'error:') THEN 'error' ELSE 'warning' END AS severity FROM l WHERE trim(line) <> ''")
def compiler_diagnostics(spark, sf):
    err = F.concat(F.lit("Main.java:"), F.col("doc_id").cast("string"), F.lit(": error: missing;\n\nnote "), "lang", F.lit("\nwarning: unchecked"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split(err, "\n")).alias("line")).filter(F.trim("line") != "")
    return rows.withColumn("severity", C.severity(F.col("line")))


# Scorecards.
pts = lambda c, p: f"CASE WHEN {c} THEN {p} ELSE 0 END"
COMP = "greatest(0, 20 - " + " - ".join([pts(n(r"class\s+\w+Test") + " = 0", 5), pts(f"NOT {has('org.junit')}", 3), pts(f"{k('{')} <> {k('}')}", 5), pts(f"{k('(')} <> {k(')')}", 3), pts(has(";;"), 2)]) + f" - 2 * ({n(chr(64) + r'Test\s+(?:public\s+)?\w+\s+\w+\s*\(')} - {n(chr(64) + r'Test\s+(?:public\s+)?void\s+\w+\s*\(')}))"
COV = f"CASE WHEN {k('@Test')} = 0 THEN 0 ELSE least(30, least(10, {k('@Test')} * 2) + least(10, 2 * (" + " + ".join(f"CAST({has(w, lower=True)} AS INTEGER)" for w in C.EDGE_WORDS) + f")) + {pts(has('assertThrows') + ' OR ' + has('expected', lower=True), 5)} + least(5, " + " + ".join(f"CAST({has(a)} AS INTEGER)" for a in C.ASSERTIONS) + ")) END"
NA = n(r"assert\w+\s*\(")
ASSERT = f"CASE WHEN {NA} = 0 THEN 0 ELSE least(20, least(10, {NA}) + CAST(floor(5.0 * " + n(r'assert\w+\s*\([^)]*,\s*"[^"]*"') + f" / {NA}) AS INTEGER) + {pts(has('assertNotNull'), 2)} + {pts(has('assertThrows'), 3)}) END"
READ_NAMES = "regexp_extract_all(source, '@Test\\s+(?:public\\s+)?void\\s+(\\w+)', 1)"
READ_BASE = f"15 - CASE WHEN len({READ_NAMES}) > 0 AND len(list_filter({READ_NAMES}, lambda x: contains(x, '_') OR contains(lower(x), 'should'))) < 0.5 * len({READ_NAMES}) THEN 3 ELSE 0 END"
READ = f"greatest(0, CASE WHEN {has('@BeforeEach', '@Before')} THEN least(15, {READ_BASE} + 2) ELSE {READ_BASE} END - CASE WHEN NOT {has('//', '/*')} THEN 2 ELSE 0 END - CASE WHEN {n(chr(92) + 'b' + chr(92) + 'd{3,}' + chr(92) + 'b')} > 3 THEN 2 ELSE 0 END - CASE WHEN len(list_filter(string_split(source, chr(10)), lambda x: length(x) > 120)) > 5 THEN 2 ELSE 0 END)"
ENV, PROPS, NEW, CALLED = (f"CAST({n(p, True)} > 0 AS INTEGER)" for p in (r"System\.getenv\s*\(", r"System\.getProperty\s*\(", r"new\s+[A-Z]\w*\s*\(", r"[a-zA-Z_]\w*\.\w+\s*\("))
MADE, IMPORTED = has("mock(", lower=True), has("import org.mockito", "static org.mockito")
FAKED = has("MockedStatic<System>", "when(System.getenv")
WITH_MOCKS = " + ".join([
    "5", f"CASE WHEN {has('when(')} AND {has('.thenReturn')} THEN 3 WHEN {MADE} THEN -2 ELSE 0 END", pts(has("verify("), 2), pts(has("@InjectMocks"), 1),
    pts(f"{ENV} = 1 AND {has('System.getenv')} AND NOT ({FAKED} OR {has('@Mock System', 'mock(System')})", -3), pts(f"{NEW} = 1 AND NOT {has('@Mock', 'mock(', 'when(')}", -3),
    pts(f"NOT {IMPORTED}", -1), pts(f"{has('@Mock')} AND NOT {has('@BeforeEach', 'MockitoAnnotations.openMocks')}", -1), pts(f"{has('@Mock')} AND NOT {has('@ExtendWith(MockitoExtension.class)')}", -1),
    f"CASE WHEN {has('when(')} AND {has('.thenReturn(')} THEN 2 WHEN {has('when(')} AND {has('.thenThrow(')} THEN 1 ELSE 0 END", pts(has("any(", "anyString(", "anyInt("), 1), pts(has("verify("), 1), pts(f"{has('verify(')} AND {has('times(', 'never(')}", 1),
    pts(has("MockedStatic", "mockStatic("), 2), pts(has("@Spy", "spy("), 1), pts(has("reset("), 1),
    f"CASE WHEN ({ENV} + {PROPS} + {NEW} + {CALLED}) = 0 THEN 0 WHEN (CASE WHEN {ENV} = 1 AND {FAKED} THEN 1 ELSE 0 END + CASE WHEN {NEW} = 1 AND {has('@Mock', 'mock(')} THEN 1 ELSE 0 END) >= 0.8 * ({ENV} + {PROPS} + {NEW} + {CALLED}) THEN 2 WHEN (CASE WHEN {ENV} = 1 AND {FAKED} THEN 1 ELSE 0 END + CASE WHEN {NEW} = 1 AND {has('@Mock', 'mock(')} THEN 1 ELSE 0 END) >= 0.5 * ({ENV} + {PROPS} + {NEW} + {CALLED}) THEN 1 ELSE 0 END",
])
MOCK = f"least(15, greatest(0, CASE WHEN {has('@Mock')} OR {MADE} OR {IMPORTED} THEN {WITH_MOCKS} WHEN {ENV} + {PROPS} + {NEW} + {CALLED} = 0 THEN 8 ELSE -5 * {ENV} - 5 * {NEW} - 2 * {PROPS} - 2 * {CALLED} END))"


def _score(name: str, sql: str, expression):
    _simple(name, f"CAST({sql} AS INTEGER)", expression, "score", tests, T, "s")


_score("score_compilability", COMP, C.compilability)
_score("score_coverage", COV, C.static_coverage)
_score("score_assertions", ASSERT, C.assertions)
_score("score_mocking", MOCK, C.mocking)
_score("score_readability", READ, C.readability)
SCORES = f"{T[:-1]}), q AS (SELECT id, CAST({COMP} AS INTEGER) AS comp, CAST({COV} AS INTEGER) AS cov, CAST({ASSERT} AS INTEGER) AS asserts, CAST({MOCK} AS INTEGER) AS mocks, CAST({READ} AS INTEGER) AS reads FROM s)"


def scores(spark, sf):
    c = F.col("source")
    return tests(spark, sf).select("id", C.compilability(c).alias("comp"), C.static_coverage(c).alias("cov"), C.assertions(c).alias("asserts"), C.mocking(c).alias("mocks"), C.readability(c).alias("reads"))


@query(f"{SCORES}, t AS (SELECT id, comp + cov + asserts + mocks + reads AS total FROM q) SELECT id, total, CASE WHEN total >= 90 THEN 'Excellent' WHEN total >= 70 THEN 'Good' WHEN total >= 50 THEN 'Needs Improvement' ELSE 'Poor' END AS level FROM t")
def quality_total_level(spark, sf):
    total = scores(spark, sf).select("id", (F.col("comp") + F.col("cov") + F.col("asserts") + F.col("mocks") + F.col("reads")).alias("total"))
    return total.withColumn("level", C.quality_level(F.col("total")))


@query(f"{SCORES} SELECT id, " + names(("compilation", "comp < 20"), ("coverage", "cov < 20"), ("assertions", "asserts < 15"), ("mocking", "mocks < 10"), ("readability", "reads < 12")) + " AS suggestions FROM q")
def suggestions(spark, sf):
    return scores(spark, sf).select("id", C.suggestions(*[F.col(x) for x in ("comp", "cov", "asserts", "mocks", "reads")]).alias("suggestions"))


@query(
    f"""{T[:-1]}), t AS (SELECT id, source || repeat(chr(10), CASE WHEN id % 4 = 0 THEN id % 400 ELSE 0 END) || repeat('@Test ', CASE WHEN id % 6 = 1 THEN id % 23 ELSE 0 END) AS test, ['High', 'high', 'very_high', 'Very High', NULL][CAST(1 + id % 50 AS INTEGER)] AS level FROM s)
SELECT id, len(string_split(test, chr(10))) > 200 OR (length(test) - length(replace(test, '@Test', ''))) // 5 > 10 OR coalesce(level, 'low') IN ('high', 'very_high')
  OR regexp_matches(test, '@Mock[A-Za-z0-9_]+|@ParameterizedTest|@TestFactory|@Nested|Stream\\.|assertThrows|@InjectMocks|verify\\(|when\\(|@ExtendWith') AS deep FROM t"""
)
def deep_evaluation(spark, sf):
    i = F.col("id")
    test = F.concat("source", F.expr("repeat('\\n', cast(if(id % 4 = 0, id % 400, 0) as int))"), F.expr("repeat('@Test ', cast(if(id % 6 = 1, id % 23, 0) as int))"))
    level = F.get(F.array(F.lit("High"), F.lit("high"), F.lit("very_high"), F.lit("Very High"), F.lit(None).cast("string")), (i % 50).cast("int"))
    return tests(spark, sf).select("id", C.needs_deep_evaluation(test, level).alias("deep"))


ANSWERS = ('Here it is: {"complexity_level": "high", "risks": {"io": [1, 2]}} Good luck.', "no JSON at all", '{"edge_cases": ["null"], "cc": 4.50, "note": null}', 'cut off: {"cc": 7, "risks": ', '{"cc": "many"} and {"cc": 2}', "[1, 2]", "{}")
DEFAULTS = '{"cc": 1, "complexity_level": "low", "risks": {"net": true}}'


@query(
    "WITH a AS (SELECT doc_id AS id, CASE doc_id % 8 WHEN 0 THEN '{\"cc\": ' || doc_id || ', \"lang\": \"' || lang || '\"}' "
    + " ".join(f"WHEN {j + 1} THEN '{a}'" for j, a in enumerate(ANSWERS))
    + rf""" END AS answer FROM documents), j AS (SELECT id, regexp_extract(answer, '(?s)\{{.*\}}') AS found FROM a), v AS (SELECT id, CAST(CASE WHEN json_valid(found) THEN found ELSE '{{}}' END AS JSON) AS own, CAST('{DEFAULTS}' AS JSON) AS rest FROM j),
m AS (SELECT id, unnest(json_keys(own)) AS name, own AS o FROM v UNION ALL SELECT id, unnest(list_filter(json_keys(rest), lambda x: NOT list_contains(json_keys(own), x))), rest FROM v)
SELECT id, name, CASE WHEN name = 'cc' AND id % 8 = 3 THEN '4.5' ELSE CAST(json_extract(o, '$.' || name) AS VARCHAR) END AS value FROM m"""
)
def answers_over_defaults(spark, sf):
    """Answers in free text, each over the same defaults, member by member; one of eight has the document's own."""
    own = F.concat(F.lit('{"cc": '), F.col("doc_id").cast("string"), F.lit(', "lang": "'), "lang", F.lit('"}'))
    answer = F.get(F.array(own, *[F.lit(a) for a in ANSWERS]), (F.col("doc_id") % 8).cast("int"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), C.json_over(answer, F.lit(DEFAULTS)).alias("m"))
    return rows.select("id", F.explode("m").alias("name", "value"))


@query("SELECT doc_id AS id, CAST(greatest(0, CASE WHEN doc_id % 101 >= 90 THEN 30 WHEN doc_id % 101 >= 80 THEN 25 WHEN doc_id % 101 >= 70 THEN 20 WHEN doc_id % 101 >= 50 THEN 15 ELSE 10 END - CASE WHEN (doc_id * 7) % 101 < 50 THEN 5 ELSE 0 END) AS INTEGER) AS score FROM documents")
def score_measured_coverage(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), C.measured_coverage(F.col("doc_id") % 101, (F.col("doc_id") * 7) % 101).alias("score"))


@query("SELECT doc_id AS id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS snippet FROM documents")
def snippet_300(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), shortened(F.col("text"), 300).alias("snippet"))


@query("SELECT doc_id AS id, concat_ws(chr(10), 'Signature: ' || source, CASE WHEN doc_id % 2 = 0 THEN 'Documentation: ' || lang END, 'Code: ' || CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END) AS body FROM documents")
def embedding_text(spark, sf):
    code = shortened(F.col("text"), 1000)
    parts = [F.concat(F.lit("Signature: "), "source"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Documentation: "), "lang")), F.concat(F.lit("Code: "), code)]
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("\n", *parts).alias("body"))

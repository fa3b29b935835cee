"""Text features and scorecards of source code, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .patterns import matching

# What counts as a decision, and as a branch, in any case.
DECISIONS = (r"\bif\s*\(", r"\bwhile\s*\(", r"\bfor\s*\(", r"\bswitch\s*\(", r"\bcatch\s*\(", r"\bcase\s+", r"\belse\s+if\s*\(", r"\?\s*.*\s*:")
BRANCHES = (r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bwhile\s*\(", r"\bfor\s*\(", r"\bswitch\s*\(", r"\bcatch\s*\(")
# Patterns that call for a deeper analysis.
DEEP = (r"@\w+", r"Stream\.", r"Optional\.", r"CompletableFuture", r"BigDecimal", r"Reflection", r"Pattern\.", r"\.map\(", r"\.filter\(", r"\.reduce\(")
# Words that look like calls or fields but are keywords.
CALL_KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "new", "throw")
# Categories of external dependencies with their patterns, read in any case. Categories of single frameworks come in as a table of the same form.
PATTERNS = (
    ("database", (r"\.save\(", r"\.findBy", r"\.delete\(", r"Repository", r"EntityManager", r"JpaRepository", r"CrudRepository", r"@Transactional", r"@Entity")),
    ("network", (r"\.get\(", r"\.post\(", r"\.put\(", r"\.delete\(", r"HttpClient", r"RestTemplate", r"WebClient", r"OkHttp", r"ApacheHttp")),
    ("file_system", (r"Files\.", r"File\.", r"\.read\(", r"\.write\(", r"Path\.", r"InputStream", r"OutputStream", r"BufferedReader", r"BufferedWriter")),
    ("logging", (r"Logger", r"\.log\(", r"LogManager", r"LoggerFactory", r"@Slf4j", r"@Log4j2")),
    ("time", (r"System\.currentTimeMillis", r"LocalDateTime", r"Instant\.", r"ZonedDateTime", r"Clock\.", r"Date\.")),
    ("random", (r"Random", r"Math\.random", r"ThreadLocalRandom", r"SecureRandom")),
    ("system", (r"System\.", r"Runtime\.", r"ProcessBuilder", r"Process\.")),
    ("environment", (r"System\.getenv\(", r"System\.getProperty\(", r"System\.setProperty\(", r'@Value\s*\(\s*"\$\{', r"@ConfigurationProperties")),
    ("object_creation", (r"new\s+[A-Z]\w*\(", r"\.newInstance\(", r"Class\.forName\(", r"BeanUtils\.", r"ObjectMapper\.")),
    ("reflection", (r"\.getClass\(", r"\.getMethod\(", r"\.invoke\(", r"Field\.", r"Constructor\.", r"Method\.")),
    ("io_operations", (r"\.read\(", r"\.write\(", r"\.flush\(", r"\.close\(", r"\.available\(", r"\.skip\(")),
    ("security", (r"SecurityContext", r"Authentication", r"Principal", r"@PreAuthorize", r"@Secured", r"BCrypt", r"JWT")),
    ("validation", (r"@Valid", r"@NotNull", r"@NotEmpty", r"@Size", r"@Pattern", r"Validator\.", r"ConstraintViolation")),
    ("serialization", (r"ObjectMapper", r"Gson", r"Jackson", r"@JsonIgnore", r"@JsonProperty", r"Serializable")),
    ("caching", (r"@Cacheable", r"@CacheEvict", r"@CachePut", r"CacheManager", r"RedisTemplate", r"@EnableCaching")),
    ("messaging", (r"@RabbitListener", r"@KafkaListener", r"@JmsListener", r"MessageProducer", r"MessageConsumer")),
    ("scheduling", (r"@Scheduled", r"@EnableScheduling", r"TaskScheduler", r"CronExpression")),
    ("configuration", (r"@Configuration", r"@Bean", r"@Component", r"@Service", r"@Repository", r"@Controller")),
    ("testing", (r"@MockBean", r"@SpyBean", r"@TestConfiguration", r"@MockitoSettings")),
    ("metrics", (r"@Timed", r"@Counted", r"MeterRegistry", r"Counter\.", r"Timer\.", r"Gauge\.")),
    ("actuator", (r"@Actuator", r"HealthIndicator", r"@Endpoint", r"@ReadOperation")),
)
# Which categories are critical, those of frameworks included; all others are medium.
HIGH = (
    "database", "network", "environment", "object_creation", "security", "file_system", "io_operations", "reflection", "validation", "serialization", "caching", "messaging",
    "spring_boot", "spring_web", "spring_security", "spring_data", "hibernate", "hibernate_advanced", "jpa_queries", "spring_batch", "spring_cloud", "spring_kafka", "spring_amqp", "microservices",
)
# Four further checks, in this case only, all critical.
SPECIFIC = (("environment", r"System\.getenv\s*\("), ("object_creation", r"new\s+[A-Z]\w*\s*\("), ("method_calls", r"[a-zA-Z_]\w*\.\w+\s*\("), ("static_calls", r"[A-Z]\w*\.\w+\s*\("))
# Names of methods that change data, or check it.
CHANGING, CHECKING = ("save", "delete", "update", "create"), ("validate", "check", "verify")


def criticality(category: str) -> str:
    return "high" if category in HIGH else "medium"


def count(c: Column, pattern: str, any_case: bool = False) -> Column:
    return F.regexp_count(c, F.lit(("(?i)" if any_case else "") + pattern)).cast("int")


def has(c: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def plain_count(c: Column, part: str) -> Column:
    """Occurrences of a string."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def lines(c: Column) -> Column:
    return F.size(F.split(c, "\n"))


def total(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def cyclomatic(c: Column) -> Column:
    return F.greatest(F.lit(1), F.lit(1) + total([count(c, p, True) for p in DECISIONS]) - count(c, r"\belse\s*\{", True))


def branches(c: Column) -> Column:
    return total([count(c, p, True) for p in BRANCHES])


def nesting(c: Column) -> Column:
    """Deepest braces; a closing brace too many doesn't count below 0."""
    braces = F.split(F.regexp_replace(c, r"[^{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a, x):
        now = F.when(x == "{", a["now"] + 1).when(x == "}", F.greatest(F.lit(0), a["now"] - 1)).otherwise(a["now"])
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(braces, start, step, lambda a: a["most"])


def level(cc: Column, branch: Column, depth: Column) -> Column:
    within = lambda a, b, d: (cc <= a) & (branch <= b) & (depth <= d)
    return F.when(within(5, 3, 2), "Low").when(within(10, 7, 4), "Medium").when(within(20, 15, 6), "High").otherwise("Very High")


def named(pairs: list[tuple[str, Column]]) -> Column:
    """The names whose conditions hold, comma-joined."""
    return F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in pairs])


def complexity_patterns(c: Column, depth: Column) -> Column:
    return named([("long", lines(c) > 20), ("deep", depth > 4), ("returns", count(c, r"\breturn\s+") > 3), ("booleans", count(c, r"\([^)]*(?:&&|\|\|)[^)]*\)") > 2)])


def needs_depth(c: Column, cc: Column, branch: Column, depth: Column) -> Column:
    return (cc > 10) | (branch > 7) | (depth > 4) | (lines(c) > 50) | c.rlike("|".join(DEEP))


def edge_cases(c: Column) -> Column:
    return named([("null_input", F.lower(c).contains("null")), ("empty_collection", has(F.lower(c), "empty", "size() == 0")), ("numeric_boundary", has(c, "== 0", "> 0", "< 0", "<= 0", ">= 0")), ("string_edge_cases", has(c, "String", "length()", "substring"))])


def exception_scenarios(c: Column) -> Column:
    return named([("explicit_exceptions", has(c, "throw new", "throws")), ("division_by_zero", has(c, "/") & (plain_count(c, "/") != plain_count(c, "//"))), ("array_index_out_of_bounds", has(c, "[") & has(c, "]"))])


def boundary_conditions(c: Column) -> Column:
    return named([("max_min_values", has(c, "MAX_VALUE", "MIN_VALUE", "Integer.MAX", "Long.MAX")), ("loop_boundaries", has(c, "for(", "while(", "do {"))])


def resource_concerns(c: Column) -> Column:
    return named([("file_operations", has(c, "File", "Files.", "InputStream", "OutputStream")), ("database_operations", has(c, "Repository", "EntityManager", "save(", "findBy")), ("network_operations", has(c, "HttpClient", "RestTemplate", "WebClient"))])


def performance_patterns(c: Column) -> dict[str, Column]:
    """Which of the four patterns a source has. Whoever heads a method is also named in it, so every method may recur."""
    # Names of the patterns and what shows them.
    return {
        "Contains loops": has(c, "for(", "while("),
        "Contains nested loops (O(n²) potential)": plain_count(c, "for(") + plain_count(c, "while(") > 1,
        "Uses Stream API": has(c, "stream()", "forEach", "map(", "filter("),
        "Potential recursion": c.rlike(r"(?U)\w+\s+\w+\s*\("),
    }


def performance_level(c: Column) -> Column:
    concerns = F.size(F.filter(F.split(resource_concerns(c), ","), lambda x: x != ""))
    patterns = total([p.cast("int") for p in performance_patterns(c).values()])
    return F.when(concerns > 2, "High Impact").when((concerns > 0) | (patterns > 2), "Medium Impact").otherwise("Low Impact")


def dependency_patterns(c: Column) -> Column:
    return named([("injection", has(c, "@Autowired", "@Inject")), ("factory", has(c, "Factory", "Builder")), ("service", has(c, "Service")), ("repository", has(c, "Repository"))])


def recommended_tests(cc: Column, edges: Column) -> Column:
    n = F.size(F.filter(F.split(edges, ","), lambda x: x != ""))
    return F.least(F.lit(15), F.lit(3) + F.when(cc > 10, 3).when(cc > 5, 2).otherwise(1) + F.least(n, F.lit(5)))


def generator_score(c: Column) -> Column:
    """A rough size of code: its control words, and brackets that are open."""
    return total([plain_count(c, w) for w in ("if", "for", "while", "switch", "catch", "try")]) + plain_count(c, "(") - plain_count(c, ")") + plain_count(c, "{") - plain_count(c, "}")


def is_async(c: Column) -> Column:
    # Words of code that runs aside.
    return has(c, "CompletableFuture", "Future", "@Async", "async", "await", "thenApply", "thenAccept")


def test_priorities(level_: Column, critical: Column, edges: Column, performance: Column) -> Column:
    """What to test first, in order."""
    first = [(level_.isin("High", "Very High"), "branches"), (critical > 0, "mocks"), (edges > 3, "edge cases"), (performance != "Low Impact", "performance")]
    return F.concat_ws(",", *[F.when(c, F.lit(n)) for c, n in first], F.lit("happy path"), F.lit("exceptions"), F.lit("boundaries"), F.lit("messages"))


def special_considerations(level_: Column, dependencies: Column, async_: Column, concerns: Column) -> Column:
    return named([("refactor", level_ == "Very High"), ("mocking", dependencies > 0), ("futures", async_), ("cleanup", concerns != "")])


def test_strategy(level_: Column, critical: Column, edges: Column, categories: Column) -> Column:
    """struct(approach, focus, patterns)."""
    hard = level_.isin("High", "Very High")
    return F.struct(
        F.when(hard, "branch-focused").otherwise("comprehensive").alias("approach"),
        named([("branches", hard), ("dependencies", critical > 0), ("edge cases", edges > 0)]).alias("focus"),
        F.concat_ws(",", F.lit("arrange-act-assert"), F.when(F.array_contains(categories, "database"), "transactions"), F.when(F.array_contains(categories, "network"), "http")).alias("patterns"),
    )


def placeholders(c: Column) -> Column:
    """Template code with numbered placeholders, scripts first; text that repeats keeps its first number."""
    for pattern, prefix in ((r"(?s)<%.*?%>", "GROOVY_EXPRESSION_"), (r"\$\{[^}]+\}", "TEMPLATE_VAR_")):
        found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        c = F.aggregate(found, c, _numbered(prefix))
    return c


def _numbered(prefix: str):
    return lambda a, e: F.replace(a, e["x"], F.concat(F.lit(prefix), e["i"].cast("string")))


def used_variables(c: Column, names: list[str]) -> Column:
    """The variables whose names a member's source holds."""
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(c, n))


def balanced_body(c: Column, start: str) -> Column:
    """From the first brace behind `start` to the one that closes it; empty if none does."""
    behind = F.substring(c, F.greatest(F.instr(c, start), F.lit(1)), F.lit(2**31 - 1))
    at = F.instr(behind, "{")
    rest = F.substring(behind, at, F.lit(2**31 - 1))
    parts = F.regexp_extract_all(rest, F.lit(r"[^{}]*[{}]"), F.lit(0))
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(0).alias("end"))

    def step(a, x):
        depth, size = a["depth"] + F.when(F.endswith(x, F.lit("{")), 1).otherwise(-1), a["size"] + F.length(x)
        open_ = a["end"] == 0
        return F.struct(F.when(open_, depth).otherwise(a["depth"]).alias("depth"), F.when(open_, size).otherwise(a["size"]).alias("size"), F.when(open_ & (depth == 0), size).otherwise(a["end"]).alias("end"))

    end = F.aggregate(parts, begin, step, lambda a: a["end"])
    return F.when(at > 0, F.substring(rest, F.lit(1), end)).otherwise("")


def package_name(c: Column) -> Column:
    return F.regexp_extract(c, r"package\s+([\w.]+)\s*;", 1)


def class_name(c: Column) -> Column:
    """The first public class, or the first one, or TestClass."""
    public, any_ = F.regexp_extract(c, r"public\s+class\s+(\w+)", 1), F.regexp_extract(c, r"class\s+(\w+)", 1)
    return F.when(public != "", public).when(any_ != "", any_).otherwise("TestClass")


# Classes that every program has.
BUILT_IN = (
    "String", "Integer", "Double", "Float", "Long", "Boolean", "Character", "Object", "Exception", "RuntimeException", "IllegalArgumentException", "NullPointerException", "IndexOutOfBoundsException",
    "System", "Math", "ArrayList", "HashMap", "HashSet", "List", "Map", "Set", "Collection", "Iterator", "Comparable", "Serializable", "Cloneable", "Runnable", "Thread", "Date", "Calendar",
    "SimpleDateFormat", "Scanner", "BufferedReader", "File", "FileReader", "FileWriter", "PrintWriter", "IOException", "FileNotFoundException", "NumberFormatException",
    "ArrayIndexOutOfBoundsException", "ClassCastException", "IllegalStateException", "UnsupportedOperationException", "ConcurrentModificationException", "NoSuchElementException", "InputMismatchException",
)


def class_references(c: Column, own: Column) -> Column:
    """Classes that code makes or takes as parameters, without itself and those that every program has."""
    made = F.regexp_extract_all(c, F.lit(r"new\s+(\w+)\s*\("), F.lit(1))
    taken = F.regexp_extract_all(c, F.lit(r"(\w+)\s+\w+\s*[,\)]"), F.lit(1))
    return F.filter(F.array_except(F.array_distinct(F.concat(made, taken)), F.array(*[F.lit(x) for x in BUILT_IN])), lambda x: x != own)


def mock_strategy(score: Column, dependencies: Column) -> Column:
    return F.when(score > 20, "comprehensive").when(score > 10, "moderate").when(dependencies > 5, "focused").otherwise("minimal")


def patterns_table(spark: SparkSession, rows=PATTERNS) -> DataFrame:
    """(category, criticality, pattern, any_case) of categories with their patterns, and of the specific checks."""
    out = [(c, criticality(c), p, True) for c, ps in rows for p in ps] + [(c, "high", p, False) for c, p in SPECIFIC]
    return spark.createDataFrame(out, "category string, criticality string, pattern string, any_case boolean")


def external_dependencies(methods: DataFrame, patterns: DataFrame | None = None, source: str = "source", key: str = "id") -> DataFrame:
    """(key, category, criticality, pattern, matches): a table of any number of patterns(category, criticality, pattern, any_case) meets every method; the built-in one if none is given."""
    return matching(methods, patterns if patterns is not None else patterns_table(methods.sparkSession), source=source, key=key)


def critical_dependencies(methods: DataFrame, found: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """(key, what, reason, criticality): called methods(key, name) that change data or check it, and the critical ones of external_dependencies."""
    low = F.lower(name)
    kind = F.when(has(low, *CHANGING), "Data modification operation").when(has(low, *CHECKING), "Validation operation")
    own = methods.select(key, F.col(name).alias("what"), kind.alias("reason")).filter("reason is not null").withColumn("criticality", F.when(F.col("reason") == "Validation operation", "medium").otherwise("high"))
    return own.unionByName(found.filter("criticality = 'high'").select(key, F.col("pattern").alias("what"), F.concat(F.lit("External "), "category", F.lit(" dependency")).alias("reason"), "criticality"))


def calls(c: Column) -> Column:
    """Distinct called names, keywords left out."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*)\s*\("), F.lit(1))), F.array(*[F.lit(k) for k in CALL_KEYWORDS]))


def fields_used(c: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?:this\.)?(\w+)(?=\s*[=;,\)])"), F.lit(1))), F.array(*[F.lit(k) for k in ("return", "null", "true", "false", "this")]))


def last_segments(c: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.element_at(F.split(x, r"\."), -1)))


def null_safety(c: Column) -> Column:
    """x.y where x is compared with null nowhere."""
    met = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\w+\.\w+(?!\s*[!=]=)"), F.lit(0)))
    owner = lambda a: F.element_at(F.split(a, r"\."), 1)
    return F.filter(met, lambda a: ~(F.contains(c, F.concat(owner(a), F.lit(" != null"))) | F.contains(c, F.concat(owner(a), F.lit(" == null")))))


def template_variables(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\$\{([^}]+)\}"), F.lit(1)))


def instantiated(c: Column, values: dict[str, str]) -> Column:
    return reduce(lambda out, kv: F.replace(out, F.lit("${" + kv[0] + "}"), F.lit(kv[1])), values.items(), c)


def json_block(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def severity(line: Column) -> Column:
    return F.when(line.contains("error:"), "error").otherwise("warning")


# Scorecards of test code.


def compilability(c: Column) -> Column:
    bad = count(c, r"@Test\s+(?:public\s+)?\w+\s+\w+\s*\(") - count(c, r"@Test\s+(?:public\s+)?void\s+\w+\s*\(")
    parts = [F.when(count(c, r"class\s+\w+Test") == 0, 5), F.when(~has(c, "org.junit"), 3), F.when(plain_count(c, "{") != plain_count(c, "}"), 5), F.when(plain_count(c, "(") != plain_count(c, ")"), 3), F.when(has(c, ";;"), 2)]
    return F.greatest(F.lit(0), F.lit(20) - total([F.coalesce(p, F.lit(0)) for p in parts]) - 2 * bad)


def measured_coverage(line: Column, branch: Column) -> Column:
    score = F.when(line >= 90, 30).when(line >= 80, 25).when(line >= 70, 20).when(line >= 50, 15).otherwise(10)
    return F.greatest(F.lit(0), score - F.when(branch < 50, 5).otherwise(0))


# Words of edge-case tests, and kinds of assertion.
EDGE_WORDS = ("null", "empty", "zero", "negative", "boundary", "edge", "maximum", "minimum", "invalid")
ASSERTIONS = ("assertEquals", "assertTrue", "assertFalse", "assertNotNull")


def static_coverage(c: Column) -> Column:
    tests = plain_count(c, "@Test")
    words = total([F.lower(c).contains(w).cast("int") for w in EDGE_WORDS])
    score = F.least(F.lit(10), tests * 2) + F.least(F.lit(10), words * 2) + F.when(has(c, "assertThrows") | F.lower(c).contains("expected"), 5).otherwise(0) + F.least(F.lit(5), total([has(c, a).cast("int") for a in ASSERTIONS]))
    return F.when(tests == 0, 0).otherwise(F.least(F.lit(30), score))


def assertions(c: Column) -> Column:
    n, messages = count(c, r"assert\w+\s*\("), count(c, r'assert\w+\s*\([^)]*,\s*"[^"]*"')
    score = F.least(F.lit(10), n) + F.floor(5 * messages / F.greatest(n, F.lit(1))).cast("int") + F.when(has(c, "assertNotNull"), 2).otherwise(0) + F.when(has(c, "assertThrows"), 3).otherwise(0)
    return F.when(n == 0, 0).otherwise(F.least(F.lit(20), score))


def mocking(c: Column) -> Column:
    """Points for mocks, their set-up and verification; penalties for what should be mocked and isn't. Fixed points, each a when."""
    pts = lambda cond, p: F.when(cond, p).otherwise(0)
    annotated, made, imported = has(c, "@Mock"), F.lower(c).contains("mock("), has(c, "import org.mockito", "static org.mockito")
    env, props, creation, called = (count(c, p, True) > 0 for p in (r"System\.getenv\s*\(", r"System\.getProperty\s*\(", r"new\s+[A-Z]\w*\s*\(", r"[a-zA-Z_]\w*\.\w+\s*\("))
    any_mock = annotated | made | imported
    setup = has(c, "when(") & has(c, ".thenReturn")
    faked_env = has(c, "MockedStatic<System>", "when(System.getenv")
    deps = env.cast("int") + props.cast("int") + creation.cast("int") + called.cast("int")
    covered = (env & faked_env).cast("int") + (creation & has(c, "@Mock", "mock(")).cast("int")
    ratio = F.try_divide(covered, deps)
    with_mocks = total([
        F.lit(5), F.when(setup, 3).when(made, -2).otherwise(0), pts(has(c, "verify("), 2), pts(has(c, "@InjectMocks"), 1),
        pts(env & has(c, "System.getenv") & ~(faked_env | has(c, "@Mock System", "mock(System")), -3), pts(creation & ~has(c, "@Mock", "mock(", "when("), -3),
        pts(~imported, -1), pts(annotated & ~has(c, "@BeforeEach", "MockitoAnnotations.openMocks"), -1), pts(annotated & ~has(c, "@ExtendWith(MockitoExtension.class)"), -1),
        F.when(has(c, "when(") & has(c, ".thenReturn("), 2).when(has(c, "when(") & has(c, ".thenThrow("), 1).otherwise(0),
        pts(has(c, "any(", "anyString(", "anyInt("), 1), pts(has(c, "verify("), 1), pts(has(c, "verify(") & has(c, "times(", "never("), 1),
        pts(has(c, "MockedStatic", "mockStatic("), 2), pts(has(c, "@Spy", "spy("), 1), pts(has(c, "reset("), 1),
        F.when(deps > 0, F.when(ratio >= 0.8, 2).when(ratio >= 0.5, 1).otherwise(0)).otherwise(0),
    ])
    without = F.when(deps == 0, 8).otherwise(pts(env, -5) + pts(creation, -5) + pts(props, -2) + pts(called, -2))
    return F.least(F.lit(15), F.greatest(F.lit(0), F.when(any_mock, with_mocks).otherwise(without)))


def readability(c: Column) -> Column:
    names = F.regexp_extract_all(c, F.lit(r"@Test\s+(?:public\s+)?void\s+(\w+)"), F.lit(1))
    good = F.size(F.filter(names, lambda n: n.contains("_") | F.lower(n).contains("should")))
    score = F.lit(15) - F.when((F.size(names) > 0) & (good < 0.5 * F.size(names)), 3).otherwise(0)
    score = F.when(has(c, "@BeforeEach", "@Before"), F.least(F.lit(15), score + 2)).otherwise(score)
    long_ = F.size(F.filter(F.split(c, "\n"), lambda x: F.length(x) > 120)) > 5
    return F.greatest(F.lit(0), score - F.when(~has(c, "//", "/*"), 2).otherwise(0) - F.when(count(c, r"\b\d{3,}\b") > 3, 2).otherwise(0) - F.when(long_, 2).otherwise(0))


def quality_level(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 70, "Good").when(score >= 50, "Needs Improvement").otherwise("Poor")


def suggestions(comp: Column, cov: Column, asserts: Column, mocks: Column, reads: Column) -> Column:
    return named([("compilation", comp < 20), ("coverage", cov < 20), ("assertions", asserts < 15), ("mocking", mocks < 10), ("readability", reads < 12)])


# Patterns of tests that are not simple.
DEEP_TESTS = (r"@Mock\w+", "@ParameterizedTest", "@TestFactory", "@Nested", r"Stream\.", "assertThrows", "@InjectMocks", r"verify\(", r"when\(", "@ExtendWith")


def needs_deep_evaluation(test: Column, complexity_level: Column) -> Column:
    """Whether a test is too hard for patterns alone: more than 200 lines, more than 10 tests, one of ten patterns, or code under test of level high or very_high, in these very words."""
    return (lines(test) > 200) | (plain_count(test, "@Test") > 10) | test.rlike("|".join(DEEP_TESTS)) | F.coalesce(complexity_level, F.lit("low")).isin("high", "very_high")


def json_over(answer: Column, defaults: Column) -> Column:
    """map of names to JSON texts: the object from the first brace to the last of a free text, over defaults (an object's JSON); the defaults alone where that is no object.

    The answer's members replace the defaults' whole, nested ones too. Members are told apart by name; of a name given twice parsing fails, as does any text that is not JSON.
    """
    # In brackets, so that nothing may follow the object; what parses as more than one is no object.
    listed = lambda text: F.from_json(F.to_json(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))), "array<map<string,variant>>")
    entries = lambda text: F.when(F.size(listed(text)) == 1, F.get(listed(text), F.lit(0)))
    texts = lambda m: F.transform_values(m, lambda k, v: F.to_json(v))
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce(texts(entries(F.regexp_extract(answer, r"(?s)\{.*\}", 0))), empty)
    rest = F.coalesce(texts(entries(defaults)), empty)
    return F.map_concat(F.map_filter(rest, lambda k, v: ~F.map_contains_key(own, k)), own)

"""Detectors over code units: every one takes units and gives rows of ISSUE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import rules

ISSUE = ["detector_id", "rule_id", "severity", "category", "message", "file", "line", "end_line", "confidence"]
HIDDEN = {"typescript", "javascript"}


def issue(df: DataFrame, detector: str, rule, severity, category: str, confidence, line: Column, message: Column, end_line: Column | None = None) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        F.lit(detector).alias("detector_id"), as_col(rule).alias("rule_id"), as_col(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"),
        "file", line.cast("int").alias("line"), (F.lit(None) if end_line is None else end_line).cast("int").alias("end_line"), as_col(confidence).cast("double").alias("confidence"),
    )


def line_rules(units: DataFrame, catalog: dict, category: dict) -> DataFrame:
    """Line rules of all catalogs on every unit: a line is reported once for each unit that holds it."""
    out = None
    in_main = F.col("source").rlike(r"package\s+main\b")
    for detector, rs in catalog.items():
        if not rs:
            continue
        x = rules.scan(units.select("file", "language", "start_line", "source", in_main.alias("in_main")), rs, ["file", "start_line", "language", "in_main"], "source", "language")
        x = x.where(~(F.col("in_main") & (F.col("rule_id") == "go-panic-in-library")))
        x = issue(x, detector, F.col("rule_id"), F.col("severity"), category[detector], F.col("confidence"), F.col("start_line") + F.col("line_no"), F.trim(F.substring("line_text", 1, 100)))
        out = x if out is None else out.unionByName(x)
    return issue(units.where("false"), "", "", "", "", 0.0, F.lit(0), F.lit("")) if out is None else out


def imports_of(units: DataFrame) -> DataFrame:
    x = units.where("kind = 'file'").select("file", "language", F.posexplode("imports").alias("ord", "i"))
    return x.select("file", "language", "ord", "i.*").withColumn("package", C.package_name(F.col("language"), F.col("module")))


def calls_of(units: DataFrame) -> DataFrame:
    return units.where("kind = 'file'").select("file", "language", F.explode("calls").alias("c")).select("file", "language", "c.*")


def hallucinated_imports(units: DataFrame, builtins: DataFrame, registry: DataFrame | None = None, dependencies: DataFrame | None = None) -> DataFrame:
    """Imports that are no builtin, and that a registry doesn't know (or, offline, that no manifest lists)."""
    x = imports_of(units).where("not is_relative").join(builtins, ["language", "package"], "left_anti")
    if registry is not None:
        answers = x.select("language", "package").distinct().join(registry, ["language", "package"], "left").where(~F.coalesce("exists", F.lit(True))).select("language", "package")
        hit = x.join(answers, ["language", "package"], "left_semi")
        return issue(hit, "hallucinated-import", "package-not-found", "error", "ai-faithfulness", 0.9, F.col("line") + 1, F.col("package"))
    if dependencies is not None:
        x = x.join(dependencies.select("package"), "package", "left_anti")
    return issue(x, "hallucinated-import", "potential-hallucination-offline", "warning", "ai-faithfulness", 0.6, F.col("line") + 1, F.col("package"))


def registry_deprecated(units: DataFrame, registry: DataFrame | None) -> DataFrame:
    """Imports of packages that a registry table (language, package, deprecated: a message or null) calls deprecated."""
    x = imports_of(units).where("not is_relative")
    if registry is None or "deprecated" not in registry.columns:
        return issue(x.where("false"), "stale-api", "registry-deprecated", "warning", "code-freshness", 0.9, F.col("line") + 1, F.col("package"))
    said = registry.where("deprecated is not null and deprecated <> ''").groupBy("language", "package").agg(F.min("deprecated").alias("_why"))
    return issue(x.join(said, ["language", "package"]), "stale-api", "registry-deprecated", "warning", "code-freshness", 0.9, F.col("line") + 1, F.concat_ws(": ", "package", "_why"))


def deprecated_modules(units: DataFrame, table: DataFrame) -> DataFrame:
    """Imports of deprecated modules: the whole module first, then its first segment."""
    x = imports_of(units).withColumn("_top", F.element_at(F.split("module", r"\."), 1))
    whole = table.select("language", F.col("module"), F.col("replacement").alias("_a"))
    top = table.select("language", F.col("module").alias("_top"), F.col("replacement").alias("_b"))
    x = x.join(whole, ["language", "module"], "left").join(top, ["language", "_top"], "left").withColumn("replacement", F.coalesce("_a", "_b")).where("replacement is not null")
    return issue(x, "stale-api", "deprecated-module", "warning", "code-freshness", 0.9, F.col("line") + 1, F.concat_ws(" -> ", "module", "replacement"))


def unused_definitions(units: DataFrame) -> DataFrame:
    defs = units.where("kind in ('function', 'class') and not exported").select("file", "name", "start_line")
    names = calls_of(units).select(F.explode(F.array("method", "callee")).alias("name")).unionByName(imports_of(units).select(F.explode("symbols").alias("name"))).distinct()
    return issue(defs.join(names, "name", "left_anti"), "context-coherence", "unused-definition", "info", "context-coherence", 0.6, F.col("start_line") + 1, F.col("name"))


# Names that need neither definition nor import.
GLOBALS = {
    "typescript": "console process require module exports globalThis window document undefined NaN Infinity Object Array String Number Boolean Symbol Map Set WeakMap WeakSet Promise Proxy Reflect JSON Math Date RegExp Error Buffer URL fetch setTimeout setInterval clearTimeout clearInterval parseInt parseFloat isNaN isFinite",
    "python": "print len range str int float bool list dict set tuple type object super isinstance issubclass enumerate zip map filter sorted reversed sum min max abs any all open input repr hash id iter next getattr setattr hasattr callable None True False Exception ValueError TypeError KeyError RuntimeError self cls",
    "java": "System String Object Integer Long Double Boolean Math Thread Exception RuntimeException Override this super",
    "go": "append cap close copy delete len make new panic print println recover nil true false iota error string int bool byte rune",
    "kotlin": "println print listOf mapOf setOf mutableListOf mutableMapOf arrayOf require check error String Int Long Boolean Any Unit this super it",
}


def undefined_references(units: DataFrame, references: DataFrame | None) -> DataFrame:
    """Unresolved references (file, language, name, line, resolved) to names that the file neither defines nor imports and that are no globals.

    A null ``resolved`` counts as unresolved. Without a table there are no references.
    """
    if references is None:
        references = units.sparkSession.createDataFrame([], "file string, language string, name string, line int, resolved boolean")
    spark = units.sparkSession
    both = lambda d, lang: d.withColumn("language", F.lit(lang))
    common = spark.createDataFrame([(lang, n) for lang, names in GLOBALS.items() for n in names.split()], "language string, name string")
    common = common.unionByName(both(common.where("language = 'typescript'"), "javascript"))
    own = units.where("kind <> 'file'").select("file", "name").unionByName(imports_of(units).select("file", F.explode("symbols").alias("name")))
    x = references.where("not coalesce(resolved, false)").join(F.broadcast(common), ["language", "name"], "left_anti").join(own, ["file", "name"], "left_anti")
    return issue(x, "context-coherence", "undefined-reference", "warning", "context-coherence", 0.7, F.col("line") + 1, F.col("name"))


def inconsistent_imports(units: DataFrame) -> DataFrame:
    """A symbol that a file imports from more than one module; the line of the second."""
    x = imports_of(units).select("file", "module", "line", "ord", F.explode("symbols").alias("symbol")).where("symbol <> '*'")
    first = x.groupBy("file", "symbol", "module").agg(F.min(F.struct("ord", "line")).alias("at"))
    r = first.withColumn("_r", F.row_number().over(Window.partitionBy("file", "symbol").orderBy("at"))).where("_r = 2")
    return issue(r, "context-coherence", "inconsistent-import", "warning", "context-coherence", 0.75, F.col("at.line") + 1, F.col("symbol"))


def duplicate_functions(units: DataFrame) -> DataFrame:
    w = Window.partitionBy("file", "parent", "name").orderBy("start_line", "ord")
    x = units.where("kind in ('function', 'method')").withColumn("_r", F.row_number().over(w)).where("_r > 1")
    return issue(x, "context-coherence", "duplicate-function", "warning", "context-coherence", 0.85, F.col("start_line") + 1, F.col("name"))


def signature_mismatches(units: DataFrame) -> DataFrame:
    """Calls of a function of another file with too many or far too few arguments, once for each such definition.

    A name's definitions are told apart by their file and number of parameters
    only, and so are its calls by theirs, before the two meet.
    """
    defs = units.where("kind = 'function'").groupBy(F.col("name").alias("method"), F.col("param_count").alias("_n")).agg(F.count("*").alias("_all"))
    own = units.where("kind = 'function'").groupBy("file", F.col("name").alias("method"), F.col("param_count").alias("_n")).agg(F.count("*").alias("_here"))
    c = calls_of(units)
    kinds = c.select("file", "method", "arg_count").distinct()
    bad = kinds.join(defs, "method").where((F.col("arg_count") > F.col("_n") + 1) | (F.col("arg_count") < F.col("_n") - 2))
    bad = bad.join(own, ["file", "method", "_n"], "left").groupBy("file", "method", "arg_count").agg(F.sum(F.col("_all") - F.coalesce("_here", F.lit(0))).cast("int").alias("_times")).where("_times > 0")
    x = c.join(bad, ["file", "method", "arg_count"]).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return issue(x, "context-coherence", "call-signature-mismatch", "warning", "context-coherence", 0.75, F.col("line") + 1, F.col("callee"))


def type_mismatches(units: DataFrame) -> DataFrame:
    """Types of one name in several files whose members differ from the first file's, either way."""
    body = F.regexp_extract("source", r"\{([^}]*)", 1)
    members = F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?m)^\s*(?:readonly\s+)?(\w+)\??\s*:"), F.lit(1)))
    x = units.where(F.col("kind") == "class").where(F.col("source").rlike(r"^(?:export\s+)?(?:interface|type|enum)\b")).select("file", "name", "start_line", members.alias("members"))
    first = x.groupBy("name").agg(F.min(F.struct("file", "start_line", "members")).alias("b"))
    y = x.join(first, "name").where("file <> b.file").withColumn("lost", F.array_except("b.members", "members")).withColumn("extra", F.array_except("members", "b.members"))
    y = y.where("size(lost) > 0 or size(extra) > 0")
    return issue(y, "context-coherence", "cross-file-type-mismatch", "warning", "context-coherence", 0.8, F.col("start_line") + 1, F.concat_ws(" ", "name", F.array_join("lost", ","), F.array_join("extra", ",")))


def enum_members(units: DataFrame) -> DataFrame:
    """Enum.member of an enum that has no such member."""
    body = F.regexp_extract("source", r"\{([^}]*)", 1)
    enums = units.where((F.col("kind") == "class") & F.col("source").rlike(r"^(?:export\s+)?(?:const\s+)?enum\b")).select("name", F.explode(F.regexp_extract_all(body, F.lit(r"(\w+)\s*(?:=[^,]*)?(?:,|\s*$)"), F.lit(1))).alias("member")).distinct()
    uses = units.where("kind = 'file'").select("file", F.posexplode(C.lines(F.col("source"))).alias("line", "text"))
    uses = uses.select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z]\w*\.\w+)\b"), F.lit(1))).alias("use"))
    uses = uses.select("file", "line", F.split_part("use", F.lit("."), F.lit(1)).alias("name"), F.split_part("use", F.lit("."), F.lit(2)).alias("member"))
    x = uses.join(enums.select("name").distinct(), "name", "left_semi").join(enums, ["name", "member"], "left_anti")
    return issue(x, "context-coherence", "invalid-enum-member", "error", "context-coherence", 0.85, F.col("line") + 1, F.concat_ws(".", "name", "member"))


#: Thresholds of over-engineering; each may be overridden.
LIMITS = {"params": 5, "nesting": 4, "lines": 100, "cyclomatic": 15}


def over_engineering(units: DataFrame, limits: dict | None = None) -> DataFrame:
    n = LIMITS | (limits or {})
    x = units.where("kind in ('function', 'method')")
    found = F.array(
        F.when(F.col("param_count") > n["params"], F.struct(F.lit("excessive-params").alias("r"), F.lit(0.8).alias("c"), F.col("param_count").alias("n"))),
        F.when(F.col("max_nesting") > n["nesting"], F.struct(F.lit("deep-nesting").alias("r"), F.lit(0.75).alias("c"), F.col("max_nesting").alias("n"))),
        F.when(F.col("loc") > n["lines"], F.struct(F.lit("long-function").alias("r"), F.lit(0.7).alias("c"), F.col("loc").alias("n"))),
        F.when(F.col("cyclomatic") > n["cyclomatic"], F.struct(F.lit("high-complexity").alias("r"), F.lit(0.85).alias("c"), F.col("cyclomatic").alias("n"))),
    )
    x = x.select("file", "name", "start_line", "end_line", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f"))
    return issue(x, "over-engineering", F.col("f.r"), "warning", "implementation", F.col("f.c"), F.col("start_line") + 1, F.concat_ws(" ", "name", F.col("f.n").cast("string")), F.col("end_line") + 1)


def excessive_abstraction(units: DataFrame, least: int = 3) -> DataFrame:
    """Files of several interfaces with one method each."""
    body = F.regexp_extract("source", r"(?s)\{(.*)\}", 1)
    one = units.where((F.col("kind") == "class") & F.col("source").rlike(r"^(?:export\s+|public\s+)?interface\b") & (F.regexp_count(body, F.lit(r"\w+\s*\([^)]*\)\s*[:;]")) == 1))
    x = one.groupBy("file").agg(F.count("*").alias("n"), F.min("start_line").alias("at")).where(F.col("n") >= least)
    return issue(x, "over-engineering", "excessive-abstraction", "info", "implementation", 0.6, F.col("at") + 1, F.col("n").cast("string"))


def single_implementations(units: DataFrame) -> DataFrame:
    """Abstract types that exactly one class implements."""
    abstract = units.where((F.col("kind") == "class") & F.col("source").rlike(r"^(?:export\s+|public\s+)*(?:abstract\s+class|interface)\b")).select("file", "name", "start_line")
    parents = F.regexp_extract_all("source", F.lit(r"^[^{]*?\b(?:extends|implements|:)\s+([\w, ]+)"), F.lit(1))
    impl = units.where("kind = 'class'").select(F.explode(F.flatten(F.transform(parents, lambda p: F.split(p, r"\s*,\s*|\s+(?:extends|implements)\s+")))).alias("name"))
    one = impl.groupBy("name").count().where("count = 1").select(F.trim("name").alias("name"))
    return issue(abstract.join(one, "name", "left_semi"), "over-engineering", "single-impl-abstraction", "warning", "implementation", 0.7, F.col("start_line") + 1, F.col("name"))


def config_depth(units: DataFrame, deeper: int = 2) -> DataFrame:
    """Chains of configuration types that refer to each other, longer than ``deeper`` steps, at their roots."""
    rule = r"\w*(?:Config|Options|Settings|Params|Props)"
    types = units.where((F.col("kind") == "class") & F.col("name").rlike(f"^{rule}$")).select("file", "name", "start_line", "source")
    refs = types.select(F.col("name").alias("from_"), F.explode(F.regexp_extract_all("source", F.lit(rf":\s*({rule})\b"), F.lit(1))).alias("to_")).where("from_ <> to_").distinct()
    refs = refs.join(types.select(F.col("name").alias("to_")).distinct(), "to_", "left_semi")
    roots = types.select("name").distinct().join(refs.select(F.col("to_").alias("name")).distinct(), "name", "left_anti")
    step = roots.select(F.col("name").alias("root"), F.col("name").alias("from_"))
    for _ in range(deeper + 1):  # a chain longer than asked is known after that many steps, cycles or not
        step = step.join(refs, "from_").select("root", F.col("to_").alias("from_")).distinct()
    deep = step.select(F.col("root").alias("name")).distinct()
    return issue(types.join(deep, "name", "left_semi"), "over-engineering", "nested-config-abstraction", "warning", "implementation", 0.7, F.col("start_line") + 1, F.col("name"))


def decorator_chains(units: DataFrame, longer_than: int = 4) -> DataFrame:
    """More than a few decorator lines in a row, over blank lines, before a declaration."""
    x = units.where("kind = 'file'").select("file", F.posexplode(C.lines(F.col("source"))).alias("line", "text")).where(F.trim("text") != "")
    mark = F.ltrim("text").startswith("@")
    w, same = Window.partitionBy("file").orderBy("line"), Window.partitionBy("file", "is_mark").orderBy("line")
    x = x.withColumn("is_mark", mark).withColumn("g", F.row_number().over(w) - F.row_number().over(same)).withColumn("next", F.lead("text").over(w))
    runs = x.where("is_mark").groupBy("file", "g").agg(F.count("*").alias("n"), F.min("line").alias("at"), F.max(F.struct("line", "next"))["next"].alias("after"))
    return issue(runs.where((F.col("n") > longer_than) & F.col("after").isNotNull()), "over-engineering", "excessive-decorator-chain", "warning", "implementation", 0.7, F.col("at") + 1, F.col("n").cast("string"))


def generics(units: DataFrame, most: int = 3) -> DataFrame:
    x = units.where("kind in ('function', 'class', 'method')").withColumn("_g", F.regexp_extract("source", r"^[^({]*?<([^<>]*)>", 1))
    n = F.size(F.split("_g", ","))
    return issue(x.where((F.col("_g") != "") & (n > most)), "over-engineering", "excessive-generics", "warning", "implementation", 0.7, F.col("start_line") + 1, F.col("name"))


def invisible_characters(units: DataFrame) -> DataFrame:
    """Every invisible code point of a file."""
    x = units.where("kind = 'file'").select("file", F.posexplode(C.lines(F.col("source"))).alias("line", "text")).where(F.col("text").rlike("[^\\x00-\\x7F]|\\x00"))
    codes = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))
    x = x.select("file", "line", F.explode(codes).alias("code")).where(C.invisible(F.col("code")))
    return issue(x, "unicode-invisible", "invisible-character", "error", "implementation", 0.95, F.col("line") + 1, C.code_label(F.col("code")))


def _body(source: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", ""), r"(?m)//[^\n]*$", "")
    return F.regexp_extract(bare, r"(?s)\{(.*)\}\s*$", 1)


def empty_bodies(units: DataFrame) -> DataFrame:
    x = units.where("kind in ('function', 'method') and language <> 'python'").where(~F.col("name").isin("constructor") & ~F.col("source").rlike(r"\babstract\b") & F.col("source").contains("{"))
    return issue(x.where(F.trim(F.regexp_replace(_body(F.col("source")), r"\s+", "")) == ""), "incomplete-implementation", "empty-function-body", "warning", "implementation", 0.75, F.col("start_line") + 1, F.col("name"), F.col("end_line") + 1)


def throw_only(units: DataFrame) -> DataFrame:
    body = F.when(F.col("language") == "python", F.regexp_replace("source", r"(?s)^.*?:\s*\n", "")).otherwise(_body(F.col("source")))
    effective = F.filter(F.transform(F.split(body, "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike(r"^(//|#|\*|/\*|\"\"\")"))
    x = units.where("kind in ('function', 'method')").withColumn("_b", effective).where(F.size("_b") == 1)
    x = x.withColumn("_s", F.get("_b", F.lit(0))).where(F.col("_s").rlike(r"^(throw|raise|panic\()"))
    stub = F.col("_s").rlike(r"(?i)not\s*implemented|NotImplemented|todo|stub|unsupported")
    return issue(x, "incomplete-implementation", "throw-only-function", F.when(stub, "error").otherwise("warning"), "implementation", F.when(stub, 0.95).otherwise(0.7), F.col("start_line") + 1, F.col("name"))


# Name endings of design patterns; functions of the standard library that return an error.
SUFFIXES = (
    "Factory Builder Provider Manager Handler Processor Resolver Strategy Adapter Decorator Observer Singleton Facade "
    "Controller Service Repository Middleware Dispatcher Supervisor Coordinator Registry Wrapper Helper Util Utility Engine"
).split()
FALLIBLE = (
    "os.Chdir os.Chmod os.Mkdir os.MkdirAll os.Remove os.RemoveAll os.Rename os.Setenv os.Symlink os.Truncate os.WriteFile os.Create os.Open "
    "io.Copy ioutil.WriteFile http.Get http.Post http.ListenAndServe json.Marshal json.Unmarshal net.Dial net.Listen exec.Command"
).split()


def pattern_names(units: DataFrame, most_lines: int = 25, most_methods: int = 2) -> DataFrame:
    """Small classes named after a design pattern."""
    methods = units.where("kind = 'method'").groupBy("file", F.col("parent").alias("name")).agg(F.count("*").alias("n"))
    x = units.where((F.col("kind") == "class") & F.col("name").rlike(f"(?:{'|'.join(SUFFIXES)})$")).join(methods, ["file", "name"], "left")
    return issue(x.where((F.col("loc") <= most_lines) & (F.coalesce("n", F.lit(0)) <= most_methods)), "over-engineering", "pattern-name-abuse", "info", "implementation", 0.6, F.col("start_line") + 1, F.col("name"))


def generic_nesting(units: DataFrame, most: int = 3) -> DataFrame:
    """Lines whose type arguments nest deeper than ``most``; arrows and comparisons with spaces don't count."""
    x = units.where("kind = 'file' and language in ('typescript', 'javascript')").select("file", F.posexplode(C.lines(F.col("source"))).alias("line", "text"))
    deep = r"\w<[^<>();]*" * (most + 1)
    return issue(x.where(F.col("text").rlike(deep)), "over-engineering", "deep-generic-nesting", "info", "implementation", 0.6, F.col("line") + 1, F.trim(F.substring("text", 1, 120)))


def unhandled_errors(units: DataFrame) -> DataFrame:
    """Go calls that return an error and stand as statements, so that nothing takes it."""
    x = units.where("language = 'go'").select("file", "start_line", C.lines(F.col("source")).alias("ls"), F.explode("calls").alias("c")).where(F.col("c.callee").isin(*FALLIBLE))
    text = F.regexp_replace(F.get("ls", F.col("c.line") - F.col("start_line")), r"^\s+", "")
    x = x.withColumn("text", text).where(F.regexp_replace("text", r"^(?:defer|go)\s+", "").startswith(F.concat("c.callee", F.lit("("))))
    return issue(x, "go-language-specific", "unhandled-error-return", "warning", "implementation", 0.7, F.col("c.line") + 1, F.substring("text", 1, 100))


def many_bangs(units: DataFrame, least: int = 3) -> DataFrame:
    """Kotlin units with several non-null assertions, at the first."""
    x = units.where("language = 'kotlin'").withColumn("_n", F.regexp_count("source", F.lit("!!"))).where(F.col("_n") >= least)
    return issue(x, "kotlin-language-specific", "excessive-bang-bang", "warning", "implementation", 0.8, F.col("start_line") + C.line_of(F.col("source"), F.instr("source", "!!") - 1) + 1, F.col("_n").cast("string"))


#: Calls that are a test, and calls that assert, by the last part of the callee.
TEST_CALLS = ["it", "test", "describe"]
ASSERTS = "^(?:expect|assert|verify|require|should|fail|check|raises|rejects)"
GO_FAILS = "^(?:t|b)\\.(?:Error|Fatal|Fail)"


def _asserts(c: Column) -> Column:
    return c["method"].rlike(ASSERTS) | c["callee"].rlike("^(?:assert|require|expect)\\.") | c["callee"].rlike(GO_FAILS)


def tests_of(units: DataFrame) -> DataFrame:
    """Functions and methods that are named or annotated as tests or call a test function, and scripts that do."""
    runs = F.exists("calls", lambda c: c["callee"].isin(*TEST_CALLS) | F.split_part(c["callee"], F.lit("."), F.lit(1)).isin(*TEST_CALLS))
    named = F.col("kind").isin("function", "method") & (F.col("name").rlike("^(?:[Tt]est|should_|when_)") | F.col("source").rlike(r"@Test\b"))
    script = (F.col("kind") == "file") & F.col("language").isin("typescript", "javascript") & runs
    return units.where(script | (F.col("kind").isin("function", "method") & (runs | named)))


def _of(x: DataFrame, rule: str, severity: str, confidence: float, line: Column | None = None, whole: bool = False) -> DataFrame:
    return issue(x, "test-antipattern", rule, severity, "context-coherence", confidence, F.col("start_line") + 1 if line is None else line, F.col("name"), F.col("end_line") + 1 if whole else None)


def test_rules(units: DataFrame) -> DataFrame:
    """Tests without assertion, trivially true, that swallow errors, that only ask for no error, or named twice."""
    t = tests_of(units)
    python_assert = (F.col("language") == "python") & F.col("source").rlike(r"(?m)^\s*assert\b")
    empty = _of(t.where(~F.exists("calls", _asserts) & ~python_assert), "empty-test-body", "error", 0.9, whole=True)

    # an assertion whose two sides are one literal, or that asserts a literal truth
    literal = r"(?:true|True|false|False|null|None|\d+|'[^']*'|\"[^\"]*\")"
    same = rf"\b\w*(?:expect|assert)\w*\s*\(\s*({literal})\s*(?:,|\)\s*\.\s*\w+\s*\()\s*\1\s*\)"
    truth = r"\bassert(?:True|That)?\s*\(?\s*[tT]rue\s*\)?\s*;?\s*$"
    lines = t.select("file", "name", "start_line", F.posexplode(C.lines(F.col("source"))).alias("i", "text")).where(F.col("text").rlike(f"{same}|{truth}"))
    trivial = _of(lines.groupBy("file", "name", "start_line").agg(F.min("i").alias("i")), "trivially-true", "warning", 0.85, F.col("start_line") + F.col("i") + 1)

    # a handler that neither asserts nor passes the error on
    handlers = F.concat(F.regexp_extract_all("source", F.lit(r"\bcatch\b[^{]*\{([^{}]*)\}"), F.lit(1)), F.regexp_extract_all("source", F.lit(r"(?m)^\s*except\b[^\n]*:\s*\n\s*([^\n]*)"), F.lit(1)))
    quiet = F.exists(handlers, lambda h: ~h.rlike(r"(?i)assert|expect|fail|throw|raise|reject|done\("))
    swallowed = _of(t.where(quiet), "swallowing-try-catch", "warning", 0.75)

    # every assertion is one that nothing was thrown
    asked = F.filter("calls", _asserts)
    unthrown = F.regexp_count("source", F.lit(r"\.\s*not\s*\.\s*toThrow\w*\("))
    none = F.size(F.filter(asked, lambda c: c["method"].rlike("(?i)(?:not|no)throws?"))) + unthrown
    only = _of(t.where((unthrown + F.size(F.filter("calls", lambda c: c["method"].rlike("(?i)not.?throw"))) > 0) & (none >= F.size(F.filter(asked, lambda c: ~c["method"].rlike("^to"))))), "no-throw-only", "info", 0.6, whole=True)

    titles = units.where("kind = 'file'").select("file", F.posexplode(C.lines(F.col("source"))).alias("line", "text"))
    titles = titles.select("file", "line", F.regexp_extract("text", r"\b(?:it|test)\s*\(\s*(['\"`])(.+?)\1", 2).alias("title")).where("title <> ''")
    again = titles.withColumn("_r", F.row_number().over(Window.partitionBy("file", "title").orderBy("line"))).where("_r > 1")
    again = issue(again, "test-antipattern", "duplicate-description", "warning", "context-coherence", 0.8, F.col("line") + 1, F.col("title"))
    return empty.unionByName(trivial).unionByName(swallowed).unionByName(only).unionByName(again)


#: What a title promises, by the first of its words found here, and what of it a test's lines would show.
PROMISES = {
    "throw": r"(?i)throw|reject|raises|catch\b",
    "reject": r"(?i)reject|throw|catch\b",
    "error": r"(?i)error|throw|reject|status\w*\W+[45]\d\d",
    "empty": r"(?i)empty|\[\s*\]|\{\s*\}|''|\"\"|\b0\b|falsy",
    "null": r"(?i)null|\bnil\b|none\b",
    "undefined": r"(?i)undefined|defined",
}


def description_mismatches(units: DataFrame) -> DataFrame:
    """Test titles that promise what the test's lines don't show; the first promise only."""
    x = units.where("kind = 'file' and language in ('typescript', 'javascript')").select("file", C.lines(F.col("source")).alias("ls"))
    starts = F.filter(F.transform("ls", lambda s, i: F.struct(i.alias("i"), F.regexp_extract(s, r"^\s*(?:it|test)(?:\.\w+)?\s*\(\s*(['\"`])(.+?)\1", 2).alias("title"), s.rlike(r"^\s*(?:it|test|describe)\b").alias("any"))), lambda s: s["any"])
    x = x.withColumn("s", starts).select("file", "ls", "s", F.posexplode("s").alias("k", "t")).where("t.title <> ''")
    # a test reaches to the next one; its title is no evidence
    stop = F.coalesce(F.get("s", F.col("k") + 1)["i"], F.size("ls"))
    body = F.array_join(F.slice("ls", F.col("t.i") + 1, stop - F.col("t.i")), "\n")
    x = x.select("file", F.col("t.i").alias("line"), F.lower("t.title").alias("title"), F.expr("t.title").alias("raw"), body.alias("body"))
    body = F.substring("body", F.instr("body", F.col("raw")) + F.length("raw"), F.length("body"))
    first = F.coalesce(*[F.when(F.col("title").contains(k), F.struct(F.lit(k).alias("word"), body.rlike(v).alias("kept"))) for k, v in PROMISES.items()])
    x = x.withColumn("p", first).where("p is not null and not p.kept")
    return issue(x, "test-antipattern", "description-body-mismatch", "info", "context-coherence", 0.6, F.col("line") + 1, F.concat_ws(": ", "title", "p.word"))

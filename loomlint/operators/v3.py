"""Detectors over whole files (file, content, language): the older generation and the chat bot's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import matching, rules, windows
from .rules import Rule

COLUMNS = ["file", "line", "detector", "type", "severity", "message"]


def _issue(df: DataFrame, detector: str, kind, severity, line: Column, message: Column) -> DataFrame:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("file", line.cast("int").alias("line"), F.lit(detector).alias("detector"), c(kind).alias("type"), c(severity).alias("severity"), message.alias("message"))


# Security types with severities and weakness ids; markers of unfinished work.
SECURITY = [
    Rule("hardcoded-secret", r"(?i)(?:api[_-]?key|secret|token|password|passwd)\s*[:=]\s*['\"][^'\"\s]{8,}['\"]", "critical", excludes=(r"(?i)process\.env|os\.environ|getenv|example|placeholder|changeme|your[_-]",)),
    Rule("hardcoded-secret-key", r"AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|-----BEGIN (?:RSA )?PRIVATE KEY-----", "critical"),
    Rule("unsafe-eval", r"\beval\s*\(|\bnew\s+Function\s*\(", "high"),
    Rule("sql-injection", r"(?i)(?:SELECT|INSERT|UPDATE|DELETE)\s.+(?:\$\{|['\"]\s*\+\s*\w)", "medium", excludes=(r"\bsql`",)),
    Rule("insecure-random", r"\bMath\.random\s*\(", "medium"),
    Rule("insecure-hash", r"(?i)createHash\(\s*['\"](?:md5|sha1)['\"]|hashlib\.(?:md5|sha1)\(", "medium"),
    Rule("insecure-cors", r"(?i)Access-Control-Allow-Origin['\"]?\s*[:,]\s*['\"]\*|cors\(\s*\)", "medium"),
    Rule("insecure-config-headers", r"(?i)\b(?:helmet|contentSecurityPolicy|hsts|frameguard|xssFilter|noSniff)\s*[:=(]\s*false\b", "medium"),
    Rule("insecure-config", r"(?i)rejectUnauthorized\s*:\s*false|verify\s*=\s*False|debug\s*[:=]\s*true", "medium"),
]
CWE = {
    "hardcoded-secret": "CWE-798", "unsafe-eval": "CWE-95", "sql-injection": "CWE-89", "insecure-random": "CWE-338", "insecure-hash": "CWE-328", "insecure-cors": "CWE-942",
    "insecure-config-headers": "CWE-693", "insecure-config": "CWE-295",
}
MARKERS = r"(?i)\b(?:TODO|FIXME|HACK|XXX|not implemented|implement (?:this|me)|placeholder)\b"
BANDS = {"complexity": (15, 25), "length": (80, 150), "nesting": (4, 6), "params": (5, 8)}


def unsuppressed(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues but those whose previous line tells a tool to ignore or disable them."""
    rows = files.select("file", F.posexplode(C.lines(F.col("content"))).alias("i", "text")).where(F.col("text").rlike(r"(?://|#|/\*)\s*\S*-?(?:ignore|disable)"))
    return issues.join(rows.select("file", (F.col("i") + 2).alias("line")), ["file", "line"], "left_anti")


def security(files: DataFrame) -> DataFrame:
    """Lines of insecure patterns outside tests, with the id of the weakness in ``cwe``."""
    x = files.where(~F.col("file").rlike(r"(?i)(?:^|/)(?:tests?|__tests__|spec)/|\.(?:test|spec)\.\w+$"))
    x = rules.scan(x, SECURITY, ["file"], "content")
    out = _issue(x, "security-pattern", F.col("rule_id"), F.col("severity"), F.col("line_no"), F.trim(F.substring("line_text", 1, 120)))
    cwe = C.literal_map(CWE, F.regexp_replace("type", "-key$", ""), None)
    return out.withColumn("cwe", cwe).withColumn("type", F.regexp_replace("type", "-(?:key|headers)$", ""))


def logic_gaps(files: DataFrame) -> DataFrame:
    """Empty catch blocks, unfinished markers, code after return or throw, awaits without error handling."""
    ls = files.select("file", C.lines(F.col("content")).alias("l"), "content")
    marks = ls.select("file", F.posexplode("l").alias("i", "t")).where(F.col("t").rlike(MARKERS))
    marks = _issue(marks, "logic-gap", "incomplete-implementation", "medium", F.col("i") + 1, F.trim("t"))
    catch = rules.scan(files, [Rule("c", r"^[^\n]*catch\s*(?:\([^)]*\))?\s*\{\s*\}", window=3)], ["file"], "content")
    catch = _issue(catch, "logic-gap", "empty-catch", "medium", F.col("line_no"), F.trim("line_text"))
    text = ls.select("file", F.posexplode("l").alias("i", "t")).where((F.trim("t") != "") & ~C.is_comment(F.col("t")))
    nxt = text.withColumn("n", F.lead("t").over(Window.partitionBy("file").orderBy("i"))).withColumn("j", F.lead("i").over(Window.partitionBy("file").orderBy("i")))
    dead = nxt.where(F.col("t").rlike(r"^\s*(?:return|throw)\b.*;\s*$") & F.col("n").isNotNull() & ~F.ltrim("n").rlike(r"^(?:\}|\)|case\b|default\b|else\b)"))
    dead = _issue(dead, "logic-gap", "unreachable-code", "low", F.col("j") + 1, F.trim("n"))
    fn = r"(?s)async\s+function\s+\w+[^{]*\{[^}]*\bawait\b[^}]*\}"
    bare = files.select("file", "content", F.explode(F.regexp_extract_all("content", F.lit(fn), F.lit(0))).alias("f")).where(~F.col("f").rlike(r"\btry\b|\.catch\("))
    bare = _issue(bare, "logic-gap", "missing-error-handling", "medium", F.size(F.split(F.split_part("content", F.col("f"), F.lit(1)), "\n", -1)), F.regexp_extract("f", r"function\s+(\w+)", 1))
    return marks.unionByName(catch).unionByName(dead).unionByName(bare)


def duplication(files: DataFrame) -> DataFrame:
    """Modules imported twice."""
    x = files.select("file", F.posexplode(C.lines(F.col("content"))).alias("i", "t")).withColumn("m", F.regexp_extract("t", r"^\s*import\s.*?from\s+['\"]([^'\"]+)['\"]", 1)).where("m <> ''")
    again = x.withColumn("r", F.row_number().over(Window.partitionBy("file", "m").orderBy("i"))).where("r > 1")
    return _issue(again, "duplication", "duplicate-import", "info", F.col("i") + 1, F.col("m"))


# Names that may be called though a file neither declares nor imports them, and words that only look like calls.
CALLABLE = set("""
    console process require module exports __dirname __filename setTimeout setInterval clearTimeout clearInterval setImmediate Promise Error Array Object String Number Boolean
    Map Set WeakMap WeakSet Symbol Proxy Reflect JSON Math Date RegExp Buffer URL URLSearchParams TextEncoder TextDecoder AbortController fetch Response Request Headers FormData
    Blob File ReadableStream WritableStream EventTarget Event CustomEvent globalThis undefined null NaN Infinity parseInt parseFloat isNaN isFinite encodeURI decodeURI
    encodeURIComponent decodeURIComponent structuredClone crypto performance queueMicrotask atob btoa describe it test expect beforeAll afterAll beforeEach afterEach vi jest
    constructor super this log warn error info debug trace count sum avg max min coalesce nullif cast next resolve reject emit on off once toString valueOf hasOwnProperty isPrototypeOf
""".split())
SYNTAX = set("""
    if for while switch catch return throw new typeof instanceof void delete await yield case in of as from import export default extends implements interface type enum namespace
    abstract declare readonly static public private protected override get set async function class const let var
""".split())
MODIFIERS = "public private protected static async override abstract"


def phantom_functions(files: DataFrame) -> DataFrame:
    """Calls of functions that the file neither declares nor imports and that are no globals.

    Methods, decorators, comments, names in capitals or of one letter are left
    alone, and so are lines without = that begin with a call, as they may be declarations.
    """
    ls = files.select("file", F.posexplode(C.lines(F.col("content"))).alias("i", "t"))
    every = lambda rule: F.regexp_extract_all("t", F.lit(rule), F.lit(1))
    listed = lambda rule: F.flatten(F.transform(every(rule), lambda g: F.split(g, ",")))
    # of "a as b" the last word is declared, of "...a: T = 1" the first
    imported = F.transform(F.concat(listed(r"\bimport\s+(?:type\s+)?(?:\w+\s*,\s*)?\{([^}]+)\}"), listed(r"\b(?:const|let|var)\s+\{([^}]+)\}\s*=\s*require\b")), lambda n: F.regexp_extract(n, r"(\w+)\s*$", 1))
    params = F.transform(F.concat(listed(r"\bfunction\s+\w+\s*\(([^)]*)\)"), listed(r"=>\s*\(([^)]*)\)")), lambda n: F.regexp_extract(n, r"^\s*(?:\.\.\.)?(\w+)", 1))
    names = F.concat(every(r"\b(?:const|let|var|function|class)\s+(\w+)"), every(r"\bimport\s+(\w+)"), imported, params)
    declared = ls.select("file", F.explode(F.array_distinct(names)).alias("name")).where("name <> ''").distinct()
    may = ~C.is_comment(F.col("t")) & ~F.ltrim("t").startswith("@") & (F.col("t").contains("=") | ~F.col("t").rlike(rf"^\s*(?:{'|'.join(MODIFIERS.split())})?\s*\w+\s*\("))
    calls = ls.where(may).select("file", "i", F.explode(every(r"(?<![\w.@])([A-Za-z]\w+)\s*\(")).alias("name"))
    calls = calls.where(~F.col("name").isin(*sorted(CALLABLE | SYNTAX)) & ~F.col("name").rlike("^[A-Z][A-Z0-9_]+$"))
    return _issue(calls.join(declared, ["file", "name"], "left_anti"), "hallucination", "phantom-function", "medium", F.col("i") + 1, F.col("name"))


def duplicate_functions(units: DataFrame, share: float = 0.8, least: int = 3) -> DataFrame:
    """Functions of a file of which ``share`` of the lines equal those of an earlier one, place by place; once for each such pair."""
    x = units.where("kind in ('function', 'method')").select("file", F.struct("file", "start_line", "ord", "name").alias("unit"), C.lines(F.col("source")).alias("_l"))
    # the first line is the declaration
    pairs = matching.near_equal_rows(x, ["file"], "unit", F.transform(F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0))), C.squeezed), share, least)
    text = F.concat(F.col("b.name"), F.lit(" is "), F.round(F.col("similarity") * 100).cast("int"), F.lit("% like "), F.col("a.name"))
    return _issue(pairs.withColumn("file", F.col("b.file")), "duplication", "duplicate-function", "low", F.col("b.start_line") + 1, text)


def context_breaks(files: DataFrame) -> DataFrame:
    """Mixed naming, module systems and asynchronous styles of a file."""
    x = files.select("file", F.posexplode(C.lines(F.col("content"))).alias("i", "t"))
    name = F.regexp_extract("t", r"(?:const|let|var|function|def)\s+([A-Za-z_$][\w$]*)", 1)
    x = x.withColumns({"snake": name.rlike("_[a-z]"), "camel": ~name.rlike("_[a-z]") & name.rlike("[a-z][A-Z]"), "esm": F.col("t").rlike(r"^\s*import\b.*\bfrom\b"), "cjs": F.col("t").rlike(r"\brequire\s*\("), "aw": F.col("t").rlike(r"\bawait\b"), "th": F.col("t").rlike(r"\.then\s*\("), "cb": F.col("t").rlike(r"\(\s*(?:err|error)\s*(?:,|\)\s*=>)")})
    n = lambda c: F.count(F.when(F.col(c), 1))
    f = x.groupBy("file").agg(n("snake").alias("snake"), n("camel").alias("camel"), n("esm").alias("esm"), F.min(F.when(F.col("cjs"), F.col("i"))).alias("cjs"), *[(n(c) > 0).cast("int").alias(c) for c in ("aw", "th", "cb")])
    mod = _issue(f.where("esm > 0 and cjs is not null"), "context-break", "module-system", "medium", F.col("cjs") + 1, F.lit("import and require"))
    styles = _issue(f.where("aw + th + cb >= 2"), "context-break", "async-style", "low", F.lit(1), F.lit("asynchronous styles"))
    mixed = f.where("snake > 0 and camel > 0").select("file", (F.col("camel") >= F.col("snake")).alias("camel_major"))
    minor = x.join(mixed, "file").where(F.when(F.col("camel_major"), F.col("snake")).otherwise(F.col("camel")))
    minor = windows.top_per(minor, ["file"], [F.col("i")], 5)
    return mod.unionByName(styles).unionByName(_issue(minor, "context-break", "naming", "low", F.col("i") + 1, F.trim("t")))


def over_engineering(units: DataFrame) -> DataFrame:
    """Complexity, length, nesting and parameters of functions by two bands."""
    of = {"complexity": "cyclomatic", "length": "loc", "nesting": "max_nesting", "params": "param_count"}
    found = F.filter(F.array(*[F.when(F.col(c) > BANDS[k][0], F.struct(F.lit(k).alias("k"), F.when(F.col(c) > BANDS[k][1], "high").otherwise("medium").alias("s"))) for k, c in of.items()]), lambda x: x.isNotNull())
    x = units.where("kind in ('function', 'method')").select("file", "name", "start_line", F.explode(found).alias("f"))
    return _issue(x, "over-engineering", F.col("f.k"), F.col("f.s"), F.col("start_line") + 1, F.col("name"))


def type_safety(files: DataFrame) -> DataFrame:
    """Uses of any (each up to five, else the first three and a summary), exported functions without a return type, double assertions, files of many non-null assertions."""
    ls = files.where("language = 'typescript'").select("file", F.posexplode(C.lines(F.col("content"))).alias("i", "t"))
    code = ls.where(~F.ltrim("t").rlike(r"^(?://|\*|/\*)"))
    found = F.concat(*[F.regexp_extract_all("t", F.lit(rule), F.lit(0)) for rule in (r":\s*any\b", r"\bas\s+any\b", "<any>")])
    uses = code.select("file", "i", "t", F.posexplode(found).alias("k", "use"))
    uses = uses.withColumn("n", F.count("*").over(Window.partitionBy("file"))).withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("i", "k")))
    sev = F.when(F.col("n") > 8, "medium").when(F.col("n") >= 4, "low").otherwise("info")
    each = _issue(uses.where("n <= 5 or r <= 3"), "type-safety", "any-usage", sev, F.col("i") + 1, F.trim("t"))
    summary = _issue(uses.where("n > 5 and r = 1"), "type-safety", "any-abuse", sev, F.lit(1), F.col("n").cast("string"))
    # what follows the last bracket of the line is the body, not a type
    untyped = code.where(F.col("t").rlike(r"^\s*export\s+(?:default\s+)?(?:async\s+)?function\s+\w+\s*\([^)]*\)\s*\{") & F.col("t").rlike(r"\)(?!\s*:)[^){]*\{[^)]*$"))
    untyped = _issue(untyped, "type-safety", "missing-return-type", "low", F.col("i") + 1, F.regexp_extract("t", r"function\s+(\w+)", 1))
    twice = _issue(code.where(F.col("t").rlike(r"\bas\s+unknown\s+as\s+\w")), "type-safety", "unsafe-assertion", "medium", F.col("i") + 1, F.trim("t"))
    bangs = ls.where(F.col("t").rlike(r"\w!(?:\.|\[|;|\))")).groupBy("file").agg(F.count("*").alias("n"), F.min("i").alias("i")).where("n > 5")
    bangs = _issue(bangs, "type-safety", "non-null-abuse", "low", F.col("i") + 1, F.col("n").cast("string"))
    return each.unionByName(summary).unionByName(untyped).unionByName(twice).unionByName(bangs)


CATALOG_ROWS = 10_000


def stale_apis(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Lines that use an API of a catalog (api, pattern, severity, replacement, deprecated_since), with the column of the first use in ``column``.

    Patterns are Java regular expressions taken from the data; each becomes a
    line rule. A catalog of over ``CATALOG_ROWS`` rows is an error, since rules
    are part of the plan. Rows without a pattern are left out; a null severity is medium.
    """
    rows = catalog.where("pattern is not null").select("api", "pattern", "severity", "replacement", "deprecated_since").limit(CATALOG_ROWS + 1).collect()
    if len(rows) > CATALOG_ROWS:
        raise ValueError(f"a catalog may have {CATALOG_ROWS} rows")
    found = [Rule(str(i), r["pattern"], r["severity"] or "medium", where="code") for i, r in enumerate(rows)]
    if not found:
        return _issue(files.where("false"), "stale-api", "deprecated-api", "medium", F.lit(1), F.lit("")).withColumn("column", F.lit(1))
    x = rules.scan(files, found, ["file"], "content")
    text = {str(i): " ".join([r["api"] or r["pattern"], *([f"(since {r['deprecated_since']})"] if r["deprecated_since"] else []), *([f"-> {r['replacement']}"] if r["replacement"] else [])]) for i, r in enumerate(rows)}
    x = x.withColumn("_pattern", C.literal_map({r.id: r.pattern for r in found}, F.col("rule_id"), "")).withColumn("_text", C.literal_map(text, F.col("rule_id"), ""))
    out = _issue(x.withColumn("_column", F.regexp_instr("line_text", F.col("_pattern"))), "stale-api", "deprecated-api", F.col("severity"), F.col("line_no"), F.concat_ws("\t", F.col("_column").cast("string"), "_text"))
    return out.withColumn("column", F.split("message", "\t", 2)[0].cast("int")).withColumn("message", F.split("message", "\t", 2)[1])


def phantom_packages(files: DataFrame, builtins: DataFrame, dependencies: DataFrame, installed: DataFrame | None = None, well_known: DataFrame | None = None) -> DataFrame:
    """Imported packages that are no builtin, in no manifest, not installed and not well known; the last two are tables (package) of the caller's."""
    ls = files.select("file", "language", F.posexplode(C.lines(F.col("content"))).alias("i", "t"))
    ts = F.regexp_extract("t", r"(?:\bfrom\s+|\brequire\s*\(\s*|^\s*import\s+)['\"]([^'\"./][^'\"]*)['\"]", 1)
    py = F.regexp_extract("t", r"^\s*(?:from|import)\s+([A-Za-z_]\w*)", 1)
    x = ls.withColumn("m", F.when(F.col("language") == "python", py).otherwise(ts)).where("m <> ''").withColumn("package", C.package_name(F.col("language"), F.col("m")))
    x = x.join(builtins, ["language", "package"], "left_anti").join(dependencies.select("package"), "package", "left_anti")
    for table in (installed, well_known):
        if table is not None:
            x = x.join(table.select("package"), "package", "left_anti")
    return _issue(x, "hallucination", "phantom-package", "high", F.col("i") + 1, F.col("package"))


def bot(files: DataFrame) -> DataFrame:
    """The bot's four detectors, severities error, warning and info."""
    from ..plans.rule_catalog import BOT_RULES

    x = rules.scan(files, BOT_RULES, ["file"], "content").where(~((F.col("rule_id") == "console-left") & F.col("file").contains("test")))
    line = F.when(F.col("rule_id") == "unreachable-after-return", F.col("line_no") + 1).otherwise(F.col("line_no"))
    lines_ = _issue(x, "bot", F.col("rule_id"), F.col("severity"), line, F.trim(F.substring("line_text", 1, 80)))
    blocks = windows.repeated_blocks(files, ["file"], text="content")
    blocks = _issue(blocks, "bot", "duplicated-block", "warning", F.col("line_no"), F.concat(F.lit("same as line "), F.col("same_as").cast("string")))
    ls = files.select("file", C.lines(F.col("content")).alias("l"))
    names = F.filter(F.transform("l", lambda s: F.regexp_extract(s, r"(?:const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)", 1)), lambda n: n != "")
    quotes = F.flatten(F.transform("l", lambda s: F.regexp_extract_all(s, F.lit(r"['\"][^'\"]*['\"]"), F.lit(0))))
    count = lambda a, f: F.size(F.filter(a, f))
    st = ls.select("file", names.alias("n"), quotes.alias("q"), F.exists("l", lambda s: s.rlike(r"\brequire\s*\(")).alias("req"), F.exists("l", lambda s: s.rlike(r"\bimport\s+|\bimport\s*\{")).alias("imp"))
    st = st.select("file", count("n", lambda n: n.rlike("_[a-z]")).alias("snake"), count("n", lambda n: ~n.rlike("_[a-z]") & n.rlike("[a-z][A-Z]")).alias("camel"), "req", "imp", count("q", lambda q: q.startswith("'")).alias("one"), F.size("q").alias("all"))
    style = F.filter(F.array(
        F.when((F.col("camel") > 2) & (F.col("snake") > 2), F.struct(F.lit("mixed-naming").alias("k"), F.lit("warning").alias("s"))),
        F.when(F.col("req") & F.col("imp"), F.struct(F.lit("mixed-modules").alias("k"), F.lit("warning").alias("s"))),
        F.when((F.col("all") > 5) & (F.least("one", F.col("all") - F.col("one")) / F.col("all") > 0.3), F.struct(F.lit("mixed-quotes").alias("k"), F.lit("info").alias("s"))),
    ), lambda z: z.isNotNull())
    st = st.select("file", F.explode(style).alias("z"))
    return lines_.unionByName(blocks).unionByName(_issue(st, "bot", F.col("z.k"), F.col("z.s"), F.lit(1), F.col("z.k")))

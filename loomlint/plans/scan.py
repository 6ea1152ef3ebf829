"""A whole scan: files to units, units to issues, issues to a score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors, matching, scoring
from ..sources import code
from . import rule_catalog, stages

# Modules that need no package, and modules that are deprecated.
BUILTINS = {
    "typescript": "assert async_hooks buffer child_process cluster console crypto dgram dns events fs http http2 https inspector module net os path perf_hooks process querystring readline stream string_decoder timers tls tty url util v8 vm worker_threads zlib node:fs node:path node:os node:url node:util node:http node:crypto",
    "python": "abc argparse array ast asyncio base64 bisect collections contextlib copy csv ctypes dataclasses datetime decimal enum functools glob gzip hashlib heapq html http importlib inspect io itertools json logging math multiprocessing operator os pathlib pickle platform queue random re secrets shutil signal socket sqlite3 ssl statistics string struct subprocess sys tempfile textwrap threading time timeit traceback types typing unittest urllib uuid warnings weakref xml zipfile zlib optparse imp distutils cgi",
    "java": "java.io java.lang java.math java.net java.nio java.nio.file java.security java.sql java.text java.time java.util java.util.concurrent java.util.function java.util.stream javax.crypto javax.net javax.sql",
    "go": "bufio bytes context crypto database/sql encoding/base64 encoding/json errors flag fmt io io/ioutil log math math/rand net net/http os os/exec path path/filepath reflect regexp sort strconv strings sync testing time unicode unicode/utf8",
    "kotlin": "kotlin kotlin.collections kotlin.io kotlin.math kotlin.text kotlin.time kotlinx.coroutines java.io java.util java.time java.net",
}
DEPRECATED_MODULES = [("python", "optparse", "argparse"), ("python", "imp", "importlib"), ("python", "distutils", "setuptools"), ("python", "cgi", "urllib.parse or email.message"), ("go", "io/ioutil", "io and os packages")]


def builtins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(lang, m) for lang, ms in BUILTINS.items() for m in ms.split()], "language string, package string")


def issues(units: DataFrame, registry: DataFrame | None = None, dependencies: DataFrame | None = None, extra=(), limits: dict | None = None, catalog: dict | None = None, deprecated: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """All detectors over units.

    ``registry`` is a table (language, package, exists, and deprecated if known);
    ``extra`` are callables from units to rows of ISSUE; ``limits`` replaces
    thresholds of over-engineering; ``catalog`` replaces line rules by detector;
    ``deprecated`` is a table (language, module, replacement) in place of the own one;
    ``references`` is a table (file, language, name, line, resolved) from a resolver, as units
    themselves tell no references.
    """
    spark = units.sparkSession
    table = spark.createDataFrame(DEPRECATED_MODULES, "language string, module string, replacement string") if deprecated is None else deprecated
    catalog = rule_catalog.V4_CATALOG | (catalog or {})
    found = [
        detectors.hallucinated_imports(units, builtins(spark), registry, dependencies), detectors.deprecated_modules(units, table), detectors.registry_deprecated(units, registry),
        detectors.unused_definitions(units), detectors.undefined_references(units, references), detectors.inconsistent_imports(units), detectors.duplicate_functions(units), detectors.signature_mismatches(units),
        detectors.type_mismatches(units), detectors.enum_members(units), detectors.over_engineering(units, limits), detectors.excessive_abstraction(units),
        detectors.single_implementations(units), detectors.config_depth(units), detectors.decorator_chains(units), detectors.generics(units), detectors.generic_nesting(units), detectors.pattern_names(units),
        detectors.unhandled_errors(units), detectors.many_bangs(units),
        detectors.line_rules(units, catalog, {d: "implementation" for d in catalog} | rule_catalog.CATEGORY), detectors.invisible_characters(units),
        detectors.empty_bodies(units), detectors.throw_only(units), detectors.test_rules(units), detectors.description_mismatches(units),
        *[f(units) for f in extra],
    ]
    return reduce(DataFrame.unionByName, found)


def scan(files: DataFrame, diff_files: DataFrame | None = None, level: str = "L1", embedder=None, providers=(), threshold: float | None = None, blocks: int | None = None, **kwargs) -> dict[str, DataFrame]:
    """``files`` (file, language, content) -> units, issues, score, file_scores, errors, stages, failures.

    Units are written once and read by all detectors. ``level`` is the service
    level: L2 adds the recall of defect patterns, L3 a model's answers on the
    files they were found in (see ``stages``).
    """
    from ..storage import save

    every = save(code.extract_units(files), "units")
    units = every.where("error is null")
    found = save(issues(units, **kwargs), "issues")
    staged = stages.run(units, found, level, embedder, providers, threshold, blocks)
    found = stages.merged(found, staged["issues"])
    if diff_files is not None:
        found = matching.in_diff(found, diff_files)
    v3 = scoring.to_v3(found)
    return {"units": units, "issues": found, "score": scoring.total(v3, []), "file_scores": scoring.total(v3, ["file"]), "errors": every.where("error is not null").select("file", F.col("error")), "stages": staged["totals"], "failures": staged["failures"]}

"""Files of a source tree on any storage Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..functions import columns as C


def read_tree(spark: SparkSession, root: str, exclude_dirs=tuple(tables.EXCLUDED_DIRS), glob: str = "*") -> DataFrame:
    """(file, language, content) of a tree; excluded directories and unknown languages are left out.

    One row per file; the reader prunes by glob before anything is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    at = F.lit(root.rstrip("/").split("://")[-1] + "/")
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    files = raw.select(F.substring(path, F.instr(path, at) + F.length(at), F.length(path)).alias("file"), F.try_validate_utf8(F.col("content")).alias("content"))
    return select_files(files, exclude_dirs)


def select_files(files: DataFrame, exclude_dirs=tuple(tables.EXCLUDED_DIRS)) -> DataFrame:
    """Adds language; drops excluded directories, unknown languages and unreadable contents."""
    x = files.withColumn("language", C.language_of(F.col("file")))
    return x.where(~C.excluded(F.col("file"), exclude_dirs) & F.col("language").isNotNull() & F.col("content").isNotNull())


def include_exclude(files: DataFrame, include: list[str], exclude: list[str], strict: bool = False) -> DataFrame:
    """Keep files by ``**/*.ext`` includes and excludes.

    By default an exclude only drops a file whose name it holds as text, or
    whose extension a ``**/*`` pattern ends with; ``strict`` reads excludes
    as globs.
    """
    name = F.element_at(F.split("file", "/"), -1)
    ext = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    wanted = [p[5:] for p in include if p.startswith("**/*.")]
    keep = F.col("file").endswith("." + wanted[0]) if wanted else F.lit(True)
    for w in wanted[1:]:
        keep = keep | F.col("file").endswith("." + w)
    for p in exclude:
        if strict:
            rule = "^" + "".join({"*": "[^/]*", ".": r"\.", "?": "."}.get(c, c) for c in p.replace("**/", "\0").replace("**", "\1")).replace("\0", "(?:.*/)?").replace("\1", ".*") + "$"
            keep = keep & ~F.col("file").rlike(rule)
        else:
            hit = F.instr(F.lit(p), name) > 0
            if p.startswith("**/*"):
                hit = hit | ((ext != "") & F.endswith(F.lit(p), ext))
            keep = keep & ~hit
    return files.where(keep)


def manifest_dependencies(manifests: DataFrame, text: str = "content") -> DataFrame:
    """(file, package) of the four dependency maps of package manifests; broken JSON gives none."""
    kinds = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
    parsed = F.from_json(text, ", ".join(f"{k} map<string,string>" for k in kinds))
    keys = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(parsed[k]), F.array().cast("array<string>")) for k in kinds])))
    return manifests.select("file", F.explode(keys).alias("package"))


def api_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalogs of deprecated APIs, JSON arrays or lines: api, pattern, replacement, deprecated_since, severity, references. Other fields are ignored."""
    fields = "api string, pattern string, replacement string, deprecated_since string, severity string, references array<string>"
    return spark.read.schema(fields).option("multiLine", True).json(path)


def cached_answers(cache: DataFrame, now: int) -> DataFrame:
    """Registry answers that are still fresh: epoch seconds ``ts`` and ``ttl``."""
    return cache.where(F.lit(now) - F.col("ts") <= F.col("ttl"))


def cache_stats(lookups: DataFrame, cache: DataFrame, now: int) -> DataFrame:
    """Entries, hits, misses and hit rate of look-ups (key) against a cache."""
    fresh = cached_answers(cache, now).select("key").distinct().withColumn("_hit", F.lit(1))
    x = lookups.join(fresh, "key", "left").agg(F.count("*").alias("lookups"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("hits"))
    return x.withColumn("misses", F.col("lookups") - F.col("hits")).withColumn("hit_rate", F.when(F.col("lookups") > 0, F.col("hits") / F.col("lookups")).otherwise(0.0))

"""Scores, grades and counts of issues: one partial aggregation on (scope, dimension), then small frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..functions import columns as C


def dimension() -> Column:
    return C.literal_map(tables.CATEGORY_DIMENSION, F.col("category"), "implementationQuality")


def deduction() -> Column:
    return C.literal_map(tables.DEDUCTIONS, F.col("severity"), 0)


def _per_dimension(issues: DataFrame, scope: list[str]) -> DataFrame:
    """One row per scope; for each dimension raw deduction and number of issues."""
    d, raw = dimension(), deduction()
    sums = []
    for name in tables.DIMENSIONS:
        sums += [F.coalesce(F.sum(F.when(d == name, raw)), F.lit(0)).alias(f"{name}_raw"), F.count(F.when(d == name, 1)).alias(f"{name}_n")]
    return issues.groupBy(*scope).agg(*sums, F.count("*").alias("issue_count"))


def _score(name: str) -> Column:
    w = tables.DIMENSIONS[name]
    return F.greatest(F.lit(0.0), C.half_up(w - F.least(F.lit(float(w)), F.col(f"{name}_raw") / 100 * w), 2))


def total(issues: DataFrame, scope: list[str], threshold: int = tables.PASS_AT) -> DataFrame:
    """Scope, dimension scores, total_score, grade, passed, issue_count."""
    x = _per_dimension(issues, scope)
    scores = {n: _score(n) for n in tables.DIMENSIONS}
    x = x.select(*scope, *[s.alias(n) for n, s in scores.items()], "issue_count")
    x = x.withColumn("total_score", C.half_up(sum((F.col(n) for n in tables.DIMENSIONS), F.lit(0.0))).cast("long"))
    return x.withColumn("grade", C.grade(F.col("total_score"))).withColumn("passed", F.col("total_score") >= threshold)


def dimensions(issues: DataFrame) -> DataFrame:
    """One row per dimension of the project, issues or not."""
    x = _per_dimension(issues, [])
    rows = [
        F.struct(
            F.lit(n).alias("dimension"), F.lit(w).alias("max_score"), _score(n).alias("score"), F.col(f"{n}_n").alias("issue_count"), F.col(f"{n}_raw").cast("long").alias("raw_deduction"),
            C.half_up(F.least(F.lit(float(w)), F.col(f"{n}_raw") / 100 * w), 2).alias("normalized_deduction"), C.half_up(_score(n) / w * 100).cast("long").alias("percentage"),
        )
        for n, w in tables.DIMENSIONS.items()
    ]
    return x.select(F.inline(F.array(*rows)))


def aggregate(issues: DataFrame, threshold: int = tables.PASS_AT) -> DataFrame:
    """Project score over all issues together, and how many files pass."""
    files = total(issues, ["file"], threshold).agg(F.count("*").alias("total_files"), F.count(F.when(F.col("passed"), 1)).alias("passed_files"))
    project = total(issues, [], threshold).select(F.col("total_score").alias("overall_score"), "grade", "passed", "issue_count")
    return project.crossJoin(files).withColumn("failed_files", F.col("total_files") - F.col("passed_files"))  # one row each


def legacy_file_scores(issues: DataFrame, group: Column) -> DataFrame:
    """Four weighted dimensions of errors (10) and others (3); ``group`` names the dimension of an issue."""
    amount = C.literal_map(tables.LEGACY_DEDUCTIONS, F.col("severity"), tables.LEGACY_DEDUCTIONS["warning"])
    x = issues.groupBy("file").agg(*[F.coalesce(F.sum(F.when(group == n, amount)), F.lit(0)).alias(n) for n in tables.LEGACY_WEIGHTS])
    parts = [F.greatest(F.lit(0.0), C.half_up(w - F.least(F.lit(float(w)), F.col(n) / 100 * w), 2)) for n, w in tables.LEGACY_WEIGHTS.items()]
    return x.select("file", C.half_up(sum(parts, F.lit(0.0))).cast("long").alias("total_score"))


def legacy_project(files: DataFrame, threshold: int = tables.PASS_AT) -> DataFrame:
    """Mean of file scores, rounded; no files score 100."""
    x = files.agg(F.count("*").alias("total_files"), F.count(F.when(F.col("total_score") >= threshold, 1)).alias("passed_files"), C.half_up(F.avg("total_score")).alias("m"))
    x = x.withColumn("overall_score", F.coalesce("m", F.lit(100)).cast("long")).drop("m")
    return x.withColumn("grade", C.grade(F.col("overall_score"), plus=False)).withColumn("passed", F.col("overall_score") >= threshold)


def penalty_scores(issues: DataFrame, penalties: dict[str, int], scope: str = "file") -> DataFrame:
    """100 less a penalty for each issue, not below 0."""
    cost = F.coalesce(F.sum(C.literal_map(penalties, F.col("severity"), 0)), F.lit(0))
    return issues.groupBy(scope).agg(F.greatest(F.lit(0), 100 - cost).cast("long").alias("score"))


def counts(issues: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Number of issues of each of the values, zero for those without."""
    x = issues.agg(*[F.count(F.when(F.col(key) == v, 1)).alias(v) for v in values])
    return x.select(F.inline(F.array(*[F.struct(F.lit(v).alias(key), F.col(f"`{v}`").alias("n")) for v in values])))


def to_v3(issues: DataFrame) -> DataFrame:
    """Detector results with their categories and severities renamed to those that are scored."""
    return issues.withColumns({
        "id": F.concat_ws(":", "detector_id", "file", "line"),
        "category": C.literal_map(tables.V4_CATEGORY, F.col("category"), "over-engineering"),
        "severity": C.literal_map(tables.V4_SEVERITY, F.col("severity"), "medium"),
    })


def severity_rank() -> Column:
    return C.literal_map({s: i for i, s in enumerate(tables.SEVERITY_ORDER)}, F.col("severity"), len(tables.SEVERITY_ORDER))

"""Reports as rows, and small renderings of them.

Rows stay distributed; only renderings for people collect, after a top-k cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import windows

SARIF_LEVEL = {"critical": "error", "high": "error", "error": "error", "medium": "warning", "warning": "warning"}
CODE_QUALITY = {"critical": "blocker", "error": "critical", "high": "critical", "warning": "major", "medium": "major", "low": "minor", "info": "info"}


def sarif_results(issues: DataFrame) -> DataFrame:
    """(json): one SARIF 2.1.0 result a row."""
    loc = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.col("line"), F.lit(1)).alias("startLine"), F.col("end_line").alias("endLine")).alias("region")).alias("physicalLocation"))
    r = F.struct(F.col("detector_id").alias("ruleId"), C.literal_map(SARIF_LEVEL, F.col("severity"), "note").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(loc).alias("locations"))
    return issues.select(F.to_json(r).alias("json"))


def sarif(issues: DataFrame, tool: str = "loomlint", version: str = "1.0") -> DataFrame:
    """(json): a whole SARIF document; for the issues of one project, not of a corpus."""
    rules = issues.agg(F.array_sort(F.collect_set(F.struct(F.col("detector_id").alias("id")))).alias("rules"))
    results = sarif_results(issues).agg(F.array_sort(F.collect_list("json")).alias("results"))
    head = F.to_json(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.col("rules")))
    doc = F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":'), head, F.lit('},"results":['), F.array_join("results", ","), F.lit("]}]}"))
    return rules.crossJoin(results).select(doc.alias("json"))  # one row each


def sarif_by_issue(issues: DataFrame, tool: str = "loomlint", version: str = "1.0") -> DataFrame:
    """(part, json): SARIF of the older generation, whose rules are the distinct issue ids (``type``); a row a rule and a row a result.

    A rule is described by the first of its issues, by file, line and message.
    """
    level = C.literal_map(SARIF_LEVEL, F.col("severity"), "note")
    first = issues.groupBy("type").agg(F.min(F.struct("file", "line", "message", "detector", level.alias("level"))).alias("f"))
    rule = F.struct(F.col("type").alias("id"), F.col("f.detector").alias("name"), F.struct(F.col("f.message").alias("text")).alias("shortDescription"), F.struct(F.col("f.level").alias("level")).alias("defaultConfiguration"))
    region = F.struct(F.greatest("line", F.lit(1)).alias("startLine"), F.lit(1).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("type").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return first.select(F.lit("rule").alias("part"), F.to_json(rule).alias("json")).unionByName(issues.select(F.lit("result").alias("part"), F.to_json(result).alias("json")))


def code_quality(issues: DataFrame) -> DataFrame:
    """(description, fingerprint, severity, path, line) of merge-request reports."""
    return issues.select(F.col("message").alias("description"), C.fingerprint(F.col("file"), F.col("line"), F.col("message")).alias("fingerprint"), C.literal_map(CODE_QUALITY, F.col("severity"), "info").alias("severity"), F.col("file").alias("path"), "line")


def json_rows(issues: DataFrame) -> DataFrame:
    return issues.select(F.to_json(F.struct(*issues.columns)).alias("json"))


def _rank() -> Column:
    return C.literal_map({"critical": 0, "error": 0, "high": 1, "warning": 2, "medium": 2, "low": 3}, F.col("severity"), 4)


def worst(issues: DataFrame, n: int = 10) -> DataFrame:
    """The n gravest issues of each file."""
    return windows.top_per(issues, ["file"], [_rank(), F.col("line"), F.col("message")], n)


def markdown(issues: DataFrame, score: DataFrame, n: int = 10, files: int = 50) -> str:
    """A table of the files with most issues, for people."""
    s = score.first()
    top = issues.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(files)
    rows = worst(issues.join(top, "file"), n).orderBy(F.desc("n"), "file", "rank").collect()
    head = f"# Scan: {s['total_score']}/100, grade {s['grade']}\n\n| file | line | severity | message |\n|---|---|---|---|\n"
    return head + "\n".join(f"| {r['file']} | {r['line']} | {r['severity']} | {(r['message'] or '').replace('|', '/')} |" for r in rows)


def html(issues: DataFrame, score: DataFrame, n: int = 10, files: int = 50) -> str:
    s = score.first()
    top = issues.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(files)
    rows = worst(issues.join(top, "file"), n).withColumn("message", C.html_escape(F.coalesce("message", F.lit("")))).orderBy(F.desc("n"), "file", "rank").collect()
    body = "".join(f"<tr><td>{r['file']}</td><td>{r['line']}</td><td>{r['severity']}</td><td>{r['message']}</td></tr>" for r in rows)
    return f"<html><body><h1>{s['total_score']}/100 ({s['grade']})</h1><table>{body}</table></body></html>"


def terminal(issues: DataFrame, score: DataFrame, n: int = 10, files: int = 50) -> str:
    """Plain text for a terminal: the gravest issues of the files with most of them, and how many more there are."""
    s = score.first()
    top = issues.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(files)
    out, last = [f"Score {s['total_score']}/100  Grade {s['grade']}  Issues {s['issue_count']}"], None
    for r in worst(issues.join(top, "file"), n).orderBy(F.desc("n"), "file", "rank").collect():
        if r["file"] != last:
            last = r["file"]
            out += ["", f"{last} ({r['n']} issues)"]
        out.append(f"  [{r['severity']}] L{r['line']}: {r['message'] or ''}")
        if r["rank"] == n and r["n"] > n:
            out.append(f"  ... and {r['n'] - n} more")
    return "\n".join(out)


def change_comment(issues: DataFrame, score: DataFrame, marker: str = "<!-- loomlint -->", n: int = 20) -> str:
    """Markdown of a comment on a change: score, counts by severity, the first n issues. It is found again by its first line."""
    s = score.first()
    counts = {r["severity"]: r["n"] for r in issues.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    out = [marker, f"## Score {s['total_score']}/100 ({s['grade']}), {'passed' if s['passed'] else 'failed'}", "", "| severity | issues |", "|---|---|"]
    out += [f"| {k} | {counts[k]} |" for k in sorted(counts)] or ["| none | 0 |"]
    for r in issues.orderBy(_rank(), "file", "line", "message").limit(n).collect():
        out += ["", f"**{r['severity']}** `{r['file']}:{r['line']}` {(r['message'] or '').replace('|', '/')}"]
    if total > n:
        out += ["", f"and {total - n} more"]
    return "\n".join(out)


def heal_summary(healed: DataFrame) -> DataFrame:
    """One row of healed files (patched, changes, original_score, fixed_score): files, healed, changes, mean improvement to one decimal."""
    gain = F.coalesce(F.avg(F.col("fixed_score").cast("double") - F.col("original_score").cast("double")), F.lit(0.0))
    return healed.agg(F.count("*").alias("files"), F.count(F.when(F.col("patched"), 1)).alias("files_healed"), F.coalesce(F.sum(F.col("changes").cast("long")), F.lit(0)).alias("issues_fixed"), F.floor(gain * 10 + 0.5).cast("double").alias("_gain")).select("files", "files_healed", "issues_fixed", (F.col("_gain") / 10).alias("mean_improvement"))


def fix_prompts(file_scores: DataFrame, issues: DataFrame, below: int = 95) -> DataFrame:
    """Files under a score, worst first, with their issues as a prompt's list."""
    text = F.concat_ws(" ", F.concat(F.lit("line "), F.col("line")), F.col("severity"), F.col("message"))
    lists = worst(issues, 20).groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("prompt"))
    return file_scores.where(F.col("total_score") < below).join(lists, "file").select("file", (100 - F.col("total_score")).alias("priority"), "prompt").orderBy(F.desc("priority"), "file")

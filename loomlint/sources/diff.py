"""Diffs: unified diff text and name-status lists, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def unified(diffs: DataFrame, key: str = "diff_id", text: str = "text") -> DataFrame:
    """One row per (diff, file): path, status, additions, deletions, changed (sorted lines of the new file).

    Carried-forward state (file, hunk) and line numbers are running windows over
    a diff's lines.
    """
    x = diffs.select(key, F.posexplode(C.lines(F.col(text))).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("line", r"^diff --git a/(.+?) b/(.+)$", 2)
    old = F.regexp_extract("line", r"^diff --git a/(.+?) b/(.+)$", 1)
    is_head = F.col("line").startswith("diff --git ")
    x = x.withColumn("file_no", F.sum(F.when(is_head, 1).otherwise(0)).over(w)).where("file_no > 0")
    x = x.withColumn("path", F.when(is_head, head)).withColumn("old", F.when(is_head, old))
    f = Window.partitionBy(key, "file_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    start = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    x = x.withColumn("start", F.when(start != "", start.cast("int"))).withColumn("hunk", F.sum(F.when(F.col("start").isNotNull(), 1).otherwise(0)).over(f))
    h = Window.partitionBy(key, "file_no", "hunk").orderBy("i")
    upto = h.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("from", F.max("start").over(h.rowsBetween(Window.unboundedPreceding, 0)))
    body = (F.col("hunk") > 0) & F.col("start").isNull() & ~F.col("line").rlike(r"^(---|\+\+\+|@@|rename (from|to)|new file mode|deleted file mode)")
    kind = F.when(body & F.col("line").startswith("+"), "+").when(body & F.col("line").startswith("-"), "-").when(body & (F.col("line").startswith(" ") | (F.col("line") == "")), " ")
    x = x.withColumn("kind", kind)
    x = x.withColumn("new_line", F.col("from") + F.coalesce(F.sum(F.when(F.col("kind").isin("+", " "), 1).otherwise(0)).over(upto), F.lit(0)))
    renamed = F.regexp_extract("line", "^rename to (.+)$", 1)
    out = x.groupBy(key, "file_no").agg(
        F.coalesce(F.max(F.when(F.col("line").startswith("rename to"), renamed)), F.max("path")).alias("path"),
        F.max("path").alias("_new"), F.max("old").alias("_old"),
        F.max(F.when(F.col("line").startswith("new file mode"), 3).when(F.col("line").startswith("deleted file mode"), 2).when(F.col("line").startswith("rename from"), 1).otherwise(0)).alias("_mode"),
        F.count(F.when(F.col("kind") == "+", 1)).alias("additions"), F.count(F.when(F.col("kind") == "-", 1)).alias("deletions"),
        F.array_sort(F.collect_set(F.when(F.col("kind").isin("+", "-") & (F.col("new_line") > 0), F.col("new_line")))).alias("changed"),
    )
    status = F.when(F.col("_mode") == 3, "added").when(F.col("_mode") == 2, "deleted").when((F.col("_mode") == 1) | (F.col("_new") != F.col("_old")), "renamed").otherwise("modified")
    return out.select(key, F.col("file_no").cast("int").alias("ord"), "path", status.alias("status"), "additions", "deletions", "changed")


def name_status(rows: DataFrame, line: str = "line") -> DataFrame:
    """Tab-separated status lines: path (the new one of a rename or copy) and status."""
    parts = F.split(F.trim(F.col(line)), "\t")
    letter = F.substring(F.get(parts, F.lit(0)), 1, 1)
    status = F.when(letter.isin("A", "C"), "added").when(letter == "D", "deleted").when(letter == "R", "renamed").otherwise("modified")
    path = F.when(letter.isin("R", "C") & (F.size(parts) >= 3), F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return rows.where(F.size(parts) >= 2).select(*[c for c in rows.columns if c != line], path.alias("path"), status.alias("status"))

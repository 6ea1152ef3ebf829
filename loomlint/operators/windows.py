"""Ordered operators: occurrences, islands, look-ahead, global places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import columns as C


def occurrences(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds occurrence, first_at and total within ``by``."""
    w = Window.partitionBy(*by)
    return rows.withColumns({
        "occurrence": F.row_number().over(w.orderBy(*order)),
        "first_at": F.min(order[0]).over(w),
        "total": F.count("*").over(w),
    })


def repeated_blocks(docs: DataFrame, key: list[str], size: int = 4, least: int = 10, text: str = "text") -> DataFrame:
    """Blocks of ``size`` lines that repeat the first block of the same text, ``size`` lines on or more."""
    x = docs.select(*key, F.transform(C.lines(F.col(text)), C.squeezed).alias("_l"))
    starts = F.when(F.size("_l") >= size, F.sequence(F.lit(0), F.size("_l") - size)).otherwise(F.array().cast("array<int>"))

    def block(i: Column) -> Column:
        return F.filter(F.slice("_l", i + 1, F.lit(size)), lambda s: F.length(s) >= least)

    rows = x.select(*key, F.explode(F.transform(starts, lambda i: F.struct(i.alias("i"), block(i).alias("b")))).alias("r"))
    rows = rows.where(F.size("r.b") >= size - 1).select(*key, F.col("r.i").alias("i"), F.md5(F.array_join("r.b", "\n").cast("binary")).alias("block"))
    first = F.min("i").over(Window.partitionBy(*key, "block"))
    return rows.withColumn("first", first).where(F.col("i") - F.col("first") >= size).select(*key, (F.col("i") + 1).alias("line_no"), (F.col("first") + 1).alias("same_as"))


def islands(rows: DataFrame, by: list[str], order: list[str], value: str, longer_than: int) -> DataFrame:
    """Runs of one value: by, value, length and the first order value of runs longer than asked."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = Window.partitionBy(*by, value).orderBy(*order)
    x = rows.withColumn("_island", F.row_number().over(w) - F.row_number().over(same))
    x = x.groupBy(*by, value, "_island").agg(F.count("*").alias("length"), F.min(order[0]).alias("starts"))
    return x.where(F.col("length") > longer_than).drop("_island")


def following(rows: DataFrame, by: list[str], order: list[str], value: str, marker: Column, marked: str) -> DataFrame:
    """Adds next_value, and next_marked: ``marked`` of the next row for which ``marker`` holds.

    The frame runs over the reversed order up to the row before, so it is a
    running value, not one search per row.
    """
    back = Window.partitionBy(*by).orderBy(*[F.col(o).desc() for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({
        "next_value": F.lead(value).over(Window.partitionBy(*by).orderBy(*order)),
        "next_marked": F.last(F.when(marker, F.col(marked)), ignorenulls=True).over(back),
    })


def numbered(rows: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """Adds place (from 0, by ``order``) and before_<c>, the sum of each whole-number column ``c`` over the rows ahead.

    No task sees all rows: they are range-partitioned and written, and only one
    row of counts a partition is added up by the driver.
    """
    spark = rows.sparkSession
    x = storage.save(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, names = F.shiftright("_at", 33), [f"before_{c}" for c in sums]
    parts = x.groupBy(part.alias("_part")).agg(F.count("*").alias("place"), *[F.sum(c).cast("long").alias(n) for c, n in zip(sums, names, strict=True)]).orderBy("_part").collect()
    ahead, offsets = [0] * (1 + len(sums)), []
    for p in parts:
        offsets.append((p["_part"], *ahead))
        ahead = [a + (v or 0) for a, v in zip(ahead, p[1:], strict=True)]
    schema = ", ".join(f"{c} bigint" for c in ("_part", "_place", *[f"_{n}" for n in names]))
    x = x.withColumn("_part", part)
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)).cast("long") for c, n in zip(sums, names, strict=True)}) if sums else x
    x = x.join(F.broadcast(spark.createDataFrame(offsets, schema)), "_part")  # one row a partition
    x = x.withColumns({"place": F.col("_place") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)), **{n: F.col(n) + F.col(f"_{n}") for n in names}})
    return x.drop("_at", "_part", "_place", *[f"_{n}" for n in names])


def top_per(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; Spark keeps n a task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)

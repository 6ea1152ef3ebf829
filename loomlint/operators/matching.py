"""Joins: look-ups that fan out, anti joins by prefix, bands, intervals, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def registry_fanout(uses: DataFrame, registry: DataFrame, on: str = "package") -> DataFrame:
    """Uses with what a registry says of their package; an unknown one counts as existing.

    Distinct packages are looked up once, then joined back.
    """
    answers = uses.select(on).distinct().join(registry, on, "left").select(on, F.coalesce("exists", F.lit(True)).alias("exists"))
    return uses.join(answers, on)


def prefix_anti(rows: DataFrame, name: str, known: DataFrame, sep: str = "/") -> DataFrame:
    """Rows of which no dotted (or slashed) prefix is known: prefixes become equi-join keys."""
    parts = F.split(F.col(name), F.lit("\\" + sep) if sep == "." else sep)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(sep, F.slice(parts, F.lit(1), i)))
    names = rows.select(name).distinct().select(name, F.explode(prefixes).alias("prefix"))
    hit = names.join(known.select(F.col(known.columns[0]).alias("prefix")), "prefix", "left_semi").select(name).distinct()
    return rows.join(hit, name, "left_anti")


def band_pairs(left: DataFrame, right: DataFrame, on: list[str], value: str, width: int) -> DataFrame:
    """Pairs equal in ``on`` whose values differ by at most ``width``: an equi-join on cells of that width."""
    cell = width + 1
    a = left.withColumn("_cell", F.floor(F.col(value) / cell))
    b = right.withColumn("_cell", F.explode(F.array(*[F.floor(F.col(value) / cell) + d for d in (-1, 0, 1)])))
    a = a.select(*on, "_cell", *[F.col(c).alias(f"a_{c}") for c in left.columns if c not in on])
    b = b.select(*on, "_cell", *[F.col(c).alias(f"b_{c}") for c in right.columns if c not in on])
    return a.join(b, [*on, "_cell"]).where(F.abs(F.col(f"a_{value}") - F.col(f"b_{value}")) <= width).drop("_cell")


#: Severities by rank, as the merge compares them.
RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def merge_bands(static: DataFrame, found: DataFrame, width: int = 3) -> DataFrame:
    """Static issues merged with a model's issues, greedily in input order within (file, category).

    Columns of both: file, category, ord, line, severity, confidence. Greedy
    assignment depends on all rows before, so a group, the issues of one
    category in one file, is read in order by one task; tasks read many groups
    in a stream. What is still open stands in a queue a line, so a row looks at
    the heads of 2 width + 1 queues, however many rows its group has. Result:
    source is static, ai or both; confidences below 0.3 go.
    """
    cols = ["file", "category", "ord", "line", "severity", "confidence"]

    def merge(batches):
        from collections import deque

        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("category", pa.string()), ("ord", pa.int64()), ("line", pa.int64()), ("severity", pa.string()), ("confidence", pa.float64()), ("source", pa.string())])
        group, queues, unplaced, place, out = None, {}, [], 0, []

        def write():
            kept = [r for r in out if r[5] is None or not r[5] < 0.3]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema, strict=True)], schema=schema) if kept else None

        def close():
            out.extend(unplaced)
            for q in queues.values():
                out.extend(x for _, x in q)

        for b in batches:
            for *r, ai in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r[:2] != group:
                    close()
                    group, queues, unplaced, place = r[:2], {}, [], 0
                line = r[3]
                heads = [q for at in range(line - width, line + width + 1) if (q := queues.get(at))] if ai and line is not None else None
                if heads:
                    q = min(heads, key=lambda q: q[0][0])
                    x = q.popleft()[1]
                    kept = r if RANK.get(r[4], 0) > RANK.get(x[4], 0) else x
                    out.append((*kept[:5], min(1.0, (x[5] or 0.9) * 1.05), "both"))
                    continue
                row = (*r[:5], (r[5] or 0.7) * 0.8 if ai else r[5], "ai" if ai else "static")
                if line is None:
                    unplaced.append(row)
                else:
                    queues.setdefault(line, deque()).append((place, row))
                place += 1
            if done := write():
                yield done
        close()
        if done := write():
            yield done

    both = static.select(*cols).withColumn("ai", F.lit(False)).unionByName(found.select(*cols).withColumn("ai", F.lit(True)))
    confidence = F.when(~F.isnan("confidence"), F.col("confidence"))
    both = both.select("file", "category", F.col("ord").cast("long"), F.col("line").cast("long"), "severity", confidence.cast("double").alias("confidence"), "ai")
    both = both.repartition("file", "category").sortWithinPartitions("file", "category", "ai", F.asc_nulls_last("ord"), "line", "severity", "confidence")
    return both.mapInArrow(merge, "file string, category string, ord long, line long, severity string, confidence double, source string")


def in_diff(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Issues that a diff touches.

    ``files``: ord, path, status, changed (array of lines). The first file that
    is equal or a suffix either way counts. Distinct issue paths meet diff
    files by their last part, an equi-join that every suffix match implies
    if paths are cut at a slash; equal last parts are then compared in full.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    paths = issues.select("file").distinct().withColumn("_base", base(F.col("file")))
    d = files.withColumn("_base", base(F.col("path")))
    match = paths.join(d, "_base").where(F.col("file").endswith(F.col("path")) | F.col("path").endswith(F.col("file")))
    first = match.withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy("ord"))).where("_r = 1").select("file", "status", "changed")
    x = issues.join(first, "file").where("status <> 'deleted'")
    inside = F.exists("changed", lambda c: (c >= F.col("line")) & (c <= F.coalesce("end_line", "line")))
    return x.where((F.col("status") == "added") | (F.size("changed") == 0) | inside).drop("status", "changed")


def chain_depths(edges: DataFrame, node: str, parent: str, rounds: int = 64) -> DataFrame:
    """(node, depth): steps from a node to its chain's root, by pointer doubling.

    A chain of n steps takes log2(n) joins; a cycle ends at ``rounds``.
    """
    from ..storage import save

    x = save(edges.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth")), "chain")
    for _ in range(rounds):
        if x.where("up is not null").isEmpty():
            break
        y = x.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        open_, done = x.where("up is not null"), x.where("up is null")
        step = open_.join(y, "up", "left").select("node", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))
        x = save(step.unionByName(done.select("node", "up", "depth")), "chain")
    return x.select("node", "depth")


def near_equal_rows(docs: DataFrame, scope: list[str], key: str, items: Column, share: float = 0.8, least: int = 3) -> DataFrame:
    """Pairs of rows of a scope whose arrays agree at ``share`` of the places of the longer one.

    Equal arrays are compared once and their rows paired at the end. If the
    longer array has m places, at most d = (1 - share) m differ, so of d + 1
    sets of places one is equal throughout: rows join on whole sets, each every
    (d + 1)-th place. Sets are laid out by classes of m. Items are compared by
    128-bit hashes, so no text is shuffled. ``items``: array of strings, none null.
    """
    from ..storage import save

    starts = [least]  # of the classes: one length each up to 16, then a quarter wide
    while starts[-1] < 1 << 31:
        starts.append(starts[-1] + 1 if starts[-1] < 16 else starts[-1] * 5 // 4)
    fixed = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    class_of = lambda n: F.size(F.filter(fixed(starts), lambda b: b <= n))
    sets = [int((1 - share) * (b - 1) + 1e-9) + 1 for b in starts[1:]]

    x = docs.select(*scope, key, items.alias("_v")).where(F.size("_v") >= least)
    x = x.select(*scope, key, F.transform("_v", lambda v: F.unhex(F.md5(v.cast("binary")))).alias("_h"))
    named = F.concat(F.to_json(F.array(*[F.col(c).cast("string") for c in scope])), F.array_join(F.transform("_h", lambda h: F.hex(h)), ""))
    x = save(x.select(*scope, key, "_h", F.unhex(F.md5(named.cast("binary"))).alias("_g")), "items")

    one = x.dropDuplicates(["_g"]).withColumn("_n", F.size("_h"))
    y = one.withColumn("_c", F.explode(F.sequence(class_of(F.col("_n")), class_of(F.floor(F.col("_n") / share + 1e-9)))))
    y = y.withColumns({"_from": F.element_at(fixed(starts), F.col("_c")), "_sets": F.element_at(fixed(sets), F.col("_c"))})
    whole = lambda s: s + F.floor((F.col("_from") - 1 - s) / F.col("_sets")) * F.col("_sets") < F.col("_n")
    y = y.withColumn("_s", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("_sets") - 1), whole)))
    places = F.transform(F.sequence("_s", F.col("_from") - 1, F.col("_sets")), lambda p: F.get("_h", p.cast("int")))
    y = y.select(F.xxhash64(*scope, "_c", "_s", places).alias("_k"), "_g", "_n", "_c")

    a, b = y.alias("a"), y.alias("b")
    long_, short = F.greatest("a._n", "b._n"), F.least("a._n", "b._n")
    met = a.join(b, (F.col("a._k") == F.col("b._k")) & (F.col("a._c") == F.col("b._c")) & (F.col("a._g") < F.col("b._g")) & (short >= share * long_))
    met = met.select(F.col("a._g").alias("_ga"), F.col("b._g").alias("_gb")).distinct()
    side = lambda g, h, scoped: one.select(F.col("_g").alias(g), F.col("_h").alias(h), F.struct(*scope).alias(scoped))
    both = met.join(side("_ga", "_ha", "_sa"), "_ga").join(side("_gb", "_hb", "_sb"), "_gb").where(F.col("_sa").eqNullSafe(F.col("_sb")))
    equal = F.size(F.filter(F.zip_with("_ha", "_hb", lambda p, q: p == q), lambda e: e))
    near = both.select("_ga", "_gb", (equal / F.greatest(F.size("_ha"), F.size("_hb"))).alias("similarity")).where(F.col("similarity") >= share)

    rows = lambda g, k: x.select(F.col("_g").alias(g), F.col(key).alias(k))
    near = near.join(rows("_ga", "_ka"), "_ga").join(rows("_gb", "_kb"), "_gb").where("_ka <> _kb")
    near = near.select(F.least("_ka", "_kb").alias("a"), F.greatest("_ka", "_kb").alias("b"), "similarity")
    same = rows("_g", "a").join(rows("_g", "b"), "_g").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return near.unionByName(same)

"""Queries of the training-data operators, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, oracles

#: Query name -> module of this subpackage.
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_decontaminate": "decontaminate",
    "op3_mix": "mixing",
    "op4_langid": "langid",
    "op5_extract": "html",
    "op6_quality": "quality",
    "op7_warc": "warc",
    "op8_license": "license",
    "op9_pii": "pii",
    "op10_simhash": "simhash",
}

#: Slot by slot: every golden-ratio point falls into one source's share, and each slot reads a block.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
l AS (SELECT *, 2.0 * source_size / weight AS level FROM r),
w AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS wanted,
         coalesce(sum(2.0 * source_size) OVER (ORDER BY level, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         sum(weight) OVER (ORDER BY level, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM l),
a AS (SELECT *, ((wanted - spent) / open_weight)::DOUBLE AS water FROM w),
f AS (SELECT water FROM a WHERE water <= level ORDER BY level, rk LIMIT 1),
t AS (SELECT rk, source, source_size, least(2.0 * source_size, coalesce((SELECT water FROM f), 'inf'::DOUBLE) * weight)::DOUBLE AS target FROM a),
b AS (SELECT *, greatest(1, least(ceil((SELECT sum(target) FROM t) / 65536), floor(target / 1024)))::BIGINT AS block FROM t),
n AS (SELECT *, ceil(source_size / block)::BIGINT AS n_blocks, round(target / block)::BIGINT AS n_slots FROM b),
c AS (SELECT *, (sum(n_slots) OVER (ORDER BY rk) - n_slots)::BIGINT AS ahead, (sum(n_slots) OVER ())::BIGINT AS slots FROM n),
h AS (SELECT *, (ahead * 4294967296) // slots AS lo, ((ahead + n_slots) * 4294967296) // slots AS hi FROM c WHERE slots > 0),
k AS (SELECT unnest(range(1, (SELECT max(slots) FROM c) + 1)) AS slot),
p AS (SELECT slot, (slot * 2654435769) % 4294967296 AS point FROM k),
q AS (SELECT h.rk, slot, row_number() OVER (PARTITION BY h.rk ORDER BY slot) - 1 AS turn FROM p JOIN h ON point >= lo AND point < hi),
v AS (SELECT q.rk, turn % n_blocks AS blk, min(slot) AS first_slot, count(*) AS times FROM q JOIN n USING (rk) WHERE turn < 2 * n_blocks GROUP BY ALL),
g AS (SELECT d.doc_id, d.size, d.source, n.rk, n.source_size, n.target, n.block,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS hi
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
x AS (SELECT *, unnest(range((hi - size) // block, (hi - 1) // block + 1)) AS blk FROM g WHERE size > 0),
o AS (SELECT x.doc_id, x.source, x.hi, sum(coalesce(times, 0) * (least(x.hi, (x.blk + 1) * block) - greatest(x.hi - size, x.blk * block)))::BIGINT AS taken,
             min(CASE WHEN x.blk = (x.hi - size) // block THEN first_slot END) AS first_slot
      FROM x LEFT JOIN v ON x.rk = v.rk AND x.blk = v.blk GROUP BY ALL)
SELECT g.doc_id, g.size, g.source_size, g.target, g.source, coalesce(taken, 0)::BIGINT AS taken, first_slot
FROM g LEFT JOIN o ON g.doc_id = o.doc_id AND g.source IS NOT DISTINCT FROM o.source AND g.hi = o.hi AND g.size > 0
"""


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(importlib.import_module(f"{__package__}.{MODULES[name]}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op6_quality is fixed by rule, without the learned verdict."""
    from . import quality

    model = quality.Model(quality.np.zeros(quality.BUCKETS), 0.0)
    return quality.score(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text", "score", "kept")


def _pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op9_pii is fixed by rule, without the spans that are discovered."""
    from . import pii

    return pii.digest(pii.detect(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in MODULES} | {"pipeline": _pipeline, "q_op6_base": _quality_base, "q_op9_base": _pii_base}


def oracle_sql() -> dict[str, str]:
    from .license import oracle
    from .warc import OP7_SQL

    return {"op2_decontaminate": oracles.OP2, "q_op6_base": oracles.OP6_BASE, "q_op9_base": oracles.OP9_BASE, "op3_mix": OP3_SQL, "op7_warc": OP7_SQL, "op8_license": oracle()}

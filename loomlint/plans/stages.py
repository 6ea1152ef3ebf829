"""Service levels: L1 runs detectors only, L2 recalls defect patterns by vectors, L3 asks a model about suspicious files.

Replies and recalled issues are written once to the shared folder, so that a
lost executor asks no provider again for what is written. A failed call is a row of
``failures``, never a failed scan. Defined results: no units give no issues;
units without text or of languages no pattern is for recall nothing; without an
available provider L3 ends as L2 does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SLA
from ..operators import detectors, similarity
from ..storage import save
from . import model_stage

# Ids, categories, severities and languages ("" for all) of defect patterns. The texts are our own.
PATTERNS = [
    ("hallucinated-import", "ai-faithfulness", "error", "", "import of a package that no registry has; import from an invented module name"),
    ("phantom-api", "ai-faithfulness", "error", "", "call of a method that the library does not offer; invented function on a known object"),
    ("fabricated-type", "ai-faithfulness", "error", "", "type annotation with a type that is defined nowhere; invented interface"),
    ("wrong-api-signature", "ai-faithfulness", "error", "", "call with wrong arguments, order or number of parameters differ from the signature"),
    ("imaginary-config-option", "ai-faithfulness", "warning", "", "option in a config object that is not supported; invented setting"),
    ("deprecated-node-api", "code-freshness", "warning", "typescript javascript", "deprecated node call: new Buffer, url.parse, fs.exists, require domain"),
    ("deprecated-python-api", "code-freshness", "warning", "python", "deprecated python module: import imp, optparse, distutils, asyncio get_event_loop"),
    ("deprecated-java-api", "code-freshness", "warning", "java kotlin", "deprecated java class: new Date year, Vector, Hashtable, Thread stop, finalize"),
    ("outdated-framework-pattern", "code-freshness", "info", "", "old framework style: class component with componentWillMount, mixin, callback router"),
    ("legacy-syntax-pattern", "code-freshness", "info", "typescript javascript", "legacy syntax: var self this, arguments callee, prototype, function constructor"),
    ("naming-inconsistency", "context-coherence", "warning", "", "names in camelCase and snake_case mixed in one file"),
    ("contradictory-comment", "context-coherence", "warning", "", "comment says one thing and code does another"),
    ("unused-variable-from-context-loss", "context-coherence", "warning", "", "variable declared and never used; leftover of an earlier draft"),
    ("abrupt-style-shift", "context-coherence", "info", "", "style changes between functions: promises then await, quotes, indentation"),
    ("duplicate-logic-different-style", "context-coherence", "info", "", "two functions do the same work, a loop in one and map in the other"),
    ("unnecessary-abstraction", "implementation", "warning", "", "abstract factory, manager or interface with a single implementation"),
    ("hardcoded-secret", "implementation", "error", "", "password, api key, token or secret written in source as a string"),
    ("empty-catch-block", "implementation", "warning", "", "try catch with an empty block; error swallowed, except pass"),
    ("todo-stub-placeholder", "implementation", "warning", "", "todo fixme stub placeholder; not implemented, return null for now"),
    ("sql-injection-risk", "implementation", "error", "", "sql query select from where built by string concatenation of user input"),
    ("insecure-random", "implementation", "warning", "", "token or password from math random instead of a secure random source"),
    ("excessive-function-complexity", "implementation", "warning", "", "one function with very many if else switch branches and deep nesting"),
]
RECALL, MODEL = "embedding-recall", "llm-deep-scan"
SNIPPET = 2000
FIRST = 3
VOCABULARY = 512


class Embedder(Protocol):
    """Vectors of texts; must be picklable, as it runs on executors."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def patterns(spark: SparkSession, rows: Iterable[tuple] = PATTERNS) -> DataFrame:
    """(ord, id, category, severity, languages, text) of a catalog in its order."""
    rows = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "ord int, id string, category string, severity string, languages string, text string")


def unit_texts(units: DataFrame) -> DataFrame:
    """Units with ``text``: imported modules, kind and name, callees and the start of the source, a line each."""
    parts = F.concat(F.transform("imports", lambda i: F.concat(F.lit("import "), i["module"])), F.array(F.concat_ws(" ", "kind", "name")), F.transform("calls", lambda c: c["callee"]), F.array(F.substring("source", 1, SNIPPET)))
    return units.withColumn("text", F.concat_ws("\n", parts))


def _similar(texts: DataFrame, rows: list[tuple], embedder: Embedder | None) -> DataFrame:
    """(unit, p, similarity) of units (unit, text) and patterns by their place; the catalog is small and every unit is held against it."""
    spark = texts.sparkSession
    if embedder is None:
        catalog = spark.createDataFrame([(f"0 {i:06d}", r[4]) for i, r in enumerate(rows)], "unit string, text string")
        corpus = catalog.unionByName(texts)
        vocab = save(similarity.vocabulary(corpus, "unit", VOCABULARY), "vocabulary")
        v = save(similarity.vectors(similarity.term_counts(corpus, "unit", vocab=vocab), vocab, "unit"), "vectors")
        # at most VOCABULARY tokens for each pattern of the catalog
        of_pattern = v.where(F.col("unit").startswith("0 ")).select(F.substring("unit", 3, 6).cast("int").alias("p"), "token", "w")
        return similarity.sparse_cosine(v.where(F.col("unit").startswith("1 ")), F.broadcast(of_pattern), "unit", "p")
    known = embedder.embed([r[4] for r in rows])

    def run(batches) -> Iterator:
        import numpy as np
        import pandas as pd

        def unit_rows(vs) -> np.ndarray:
            a = np.asarray(vs, dtype=float)
            return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)

        right = unit_rows(known)
        for b in batches:
            s = unit_rows(embedder.embed(list(b["text"]))) @ right.T
            yield pd.DataFrame({"unit": np.repeat(b["unit"].to_numpy(), len(known)), "p": np.tile(np.arange(len(known)), len(b)), "similarity": s.ravel()})

    return texts.mapInPandas(run, "unit string, p int, similarity double")


def recall(units: DataFrame, threshold: float = SLA["L2"]["similarity"], rows: list[tuple] = PATTERNS, embedder: Embedder | None = None) -> DataFrame:
    """Issues of units whose text is like a pattern's: the first ``FIRST`` patterns in catalog order, confidence the similarity."""
    x = unit_texts(units).withColumn("unit", F.concat_ws(" ", F.lit("1"), "file", "ord"))
    x = save(x.select("unit", "file", "language", "start_line", "text"), "unit-texts")
    similar = _similar(x.select("unit", "text"), rows, embedder).where(F.col("similarity") >= threshold)
    table = patterns(units.sparkSession, rows).drop("text").withColumnRenamed("ord", "p")
    for_language = (F.col("languages") == "") | F.array_contains(F.split("languages", " "), F.col("language"))
    x = similar.join(x.drop("text"), "unit").join(F.broadcast(table), "p").where(for_language)
    x = similarity.first_matches(x, "unit", "p", FIRST, threshold)
    return x.select(
        F.lit(RECALL).alias("detector_id"), F.col("id").alias("rule_id"), "severity", "category", F.col("id").alias("message"), "file", (F.col("start_line") + 1).alias("line"),
        F.lit(None).cast("int").alias("end_line"), F.col("similarity").alias("confidence"),
    )


def suspicious(units: DataFrame, recalled: DataFrame, threshold: float = 0.0) -> DataFrame:
    """All units of every file of which something was recalled."""
    return units.join(recalled.where(F.col("confidence") >= threshold).select("file").distinct(), "file", "left_semi")


def choose(providers: Iterable[model_stage.Provider]):
    """The first provider that is available, local ones being listed first; None if none is. One that can't tell is taken for available."""
    return next((p for p in providers if getattr(p, "available", lambda: True)()), None)


def run(units: DataFrame, structural: DataFrame, level: str = "L1", embedder: Embedder | None = None, providers: Iterable = (), threshold: float | None = None, blocks: int | None = None, rows: list[tuple] = PATTERNS) -> dict[str, DataFrame]:
    """``issues``: rows of ISSUE and their stage; ``totals``: issues and tokens by stage; ``failures``: calls that failed.

    ``threshold`` and ``blocks`` default to those of the level.
    """
    if level not in SLA:
        raise ValueError(f"level must be one of {', '.join(SLA)}")
    threshold = SLA[level]["similarity"] if threshold is None else threshold
    blocks = SLA[level]["max_blocks"] if blocks is None else blocks
    spark = units.sparkSession
    ran, failures, tokens = ["structural"], spark.createDataFrame([], "file string, error string"), spark.createDataFrame([], "stage string, tokens bigint")
    found = structural.select(*detectors.ISSUE, F.lit("structural").alias("stage"))
    if level != "L1":
        recalled = save(recall(units, threshold, rows, embedder), "recalled")
        found = found.unionByName(recalled.withColumn("stage", F.lit("embedding")))
        ran.append("embedding")
    if level == "L3":
        ran.append("model")
        provider = choose(providers)
        if provider is not None:
            replies = save(model_stage.replies(suspicious(units, recalled, threshold), provider, blocks), "replies")
            failures = replies.where("error is not null").select("file", "error")
            tokens = replies.agg(F.lit("model").alias("stage"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
            said = model_stage.parse_replies(replies.where("error is null").select("file", "reply"))
            said = said.select(F.lit(MODEL).alias("detector_id"), F.lit("detected").alias("rule_id"), "severity", "category", "message", "file", "line", F.lit(None).cast("int").alias("end_line"), "confidence")
            found = found.unionByName(said.withColumn("stage", F.lit("model")))
    return {"issues": found, "totals": totals(found, ran, tokens), "failures": failures}


def totals(issues: DataFrame, ran: list[str], tokens: DataFrame | None = None) -> DataFrame:
    """(stage, issues, tokens): a row for every stage that ran, in any case."""
    spark = issues.sparkSession
    names = spark.createDataFrame([(s,) for s in ran], "stage string")
    used = spark.createDataFrame([], "stage string, tokens bigint") if tokens is None else tokens
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return names.join(issues.groupBy("stage").agg(F.count("*").alias("issues")), "stage", "left").join(used, "stage", "left").select("stage", zero("issues"), zero("tokens"))


def merged(structural: DataFrame, staged: DataFrame) -> DataFrame:
    """A scan's issues with those of later stages; the structural ones are there already."""
    return structural.unionByName(staged.where("stage <> 'structural'").select(*structural.columns))

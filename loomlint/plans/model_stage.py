"""The stage that asks a language model: prompts, a provider behind a protocol, replies as rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

BLOCKS = 20
CONFIDENCE = 0.8


class Provider(Protocol):
    """Answers prompts; must be picklable, as it runs on executors. ``available() -> bool`` is optional."""

    def complete(self, prompt: str) -> str | tuple[str, int]: ...


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Issues of replies: a list or {"issues": list}, in a code fence or not; what isn't JSON gives none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.col(reply)), r"^```[^\n]*\n", ""), r"\n\s*```\s*$", "")
    item = "line string, severity string, message string, category string"
    both = F.coalesce(F.from_json(bare, f"issues array<struct<{item.replace(' ', ':').replace(',:', ',')}>>")["issues"], F.from_json(bare, f"array<struct<{item.replace(' ', ':').replace(',:', ',')}>>"))
    x = replies.select(*[c for c in replies.columns if c != reply], F.explode(both).alias("i")).where("i.line is not null and i.message is not null")
    line = F.greatest(F.lit(1), F.coalesce(F.floor(F.expr("try_cast(i.line as double)")), F.lit(1))).cast("int")
    return x.select(*[c for c in x.columns if c != "i"], line.alias("line"), C.severity_of(F.col("i.severity")).alias("severity"), C.category_of(F.coalesce("i.category", F.lit("implementation"))).alias("category"), F.col("i.message").alias("message"), F.lit(CONFIDENCE).alias("confidence"))


def replies(units: DataFrame, provider: Provider, blocks: int = BLOCKS) -> DataFrame:
    """(file, reply, tokens, error): a provider's answers about the first units, in order; a failed call is a row with its error.

    The cut is the feature: it bounds what is sent, and stands below the Python
    call. An answer is a text, or a text and the number of tokens it took.
    """
    chosen = units.orderBy("file", "ord").limit(blocks).select("file", F.concat(F.lit("Review this code. Reply with JSON issues.\n"), F.substring("source", 1, 4000)).alias("prompt"))

    def answer(prompt: str) -> tuple:
        try:
            got = provider.complete(prompt)
        except Exception as e:  # noqa: BLE001  one failed block must not fail the scan
            return None, 0, f"{type(e).__name__}: {e}"
        return (got, 0, None) if isinstance(got, str) else (got[0], int(got[1]), None)

    def run(batches) -> Iterator:
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(f, *answer(p)) for f, p in zip(b["file"], b["prompt"], strict=True)], columns=["file", "reply", "tokens", "error"])

    return chosen.mapInPandas(run, "file string, reply string, tokens bigint, error string")


def ask(units: DataFrame, provider: Provider, blocks: int = BLOCKS) -> DataFrame:
    """Issues that a provider finds in the first units, in order; a failed call gives none."""
    return parse_replies(replies(units, provider, blocks).where("error is null").select("file", "reply"))

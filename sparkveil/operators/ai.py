"""Advisory flags from a text provider: prompts, tolerant parsing of answers, and anchoring in the text. Nothing here redacts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.text import clamped, json_block, truncated

FLAG = "array<struct<matched_text:string,entity_type:string,confidence:string,rationale:string,suggested_exemption:string>>"
Provider = Callable[[str], str]


def null_provider(prompt: str) -> str:
    return '{"flags": []}'


def answered(sources: DataFrame, provider: Provider, limit: int = 8000) -> DataFrame:
    """source_type, source_id, text, answer (null where the provider failed). The provider sees a truncated text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(prompt: str) -> str | None:
            try:
                return provider(prompt)
            except Exception:  # one text's failure is counted, not raised
                return None

        for f in frames:
            f["answer"] = [ask(p) for p in f.pop("prompt")]
            yield f

    rows = sources.where(F.trim("text") != "").select("source_type", "source_id", "text", truncated(F.col("text"), limit).alias("prompt"))
    return rows.mapInPandas(run, "source_type string, source_id long, text string, answer string")


def parsed(answers: DataFrame) -> DataFrame:
    """Raw flags of each answer: the JSON between its first and last brace."""
    body = F.from_json(json_block(F.col("answer")), f"struct<flags:{FLAG}>")
    return answers.select("source_type", "source_id", "text", F.inline(F.coalesce(body["flags"], F.from_json(F.lit("[]"), FLAG))))


def anchored(flags: DataFrame) -> DataFrame:
    """Flags at the first place of their text; those that are nowhere go, equal spans of one type are kept once."""
    needle = F.trim("matched_text")
    rows = flags.select("*", (F.instr("text", needle) - 1).alias("start"), needle.alias("needle")).where("start >= 0 AND needle <> ''")
    rows = rows.select(
        "source_type", "source_id", F.coalesce(F.nullif(F.upper(F.trim("entity_type")), F.lit("")), F.lit("OTHER")).alias("entity_type"), "start", (F.col("start") + F.length("needle")).alias("end"),
        F.col("needle").alias("matched_text"), clamped(F.col("confidence")).alias("confidence"), F.substring("rationale", 1, 1000).alias("rationale"), "suggested_exemption",
    )
    return rows.dropDuplicates(["source_type", "source_id", "start", "end", "entity_type"])


def unseen(flags: DataFrame, stored: DataFrame, provider: str) -> DataFrame:
    """Flags that this provider has not raised before."""
    key = ["source_type", "source_id", "start", "end", "entity_type"]
    return flags.join(stored.where(F.col("provider") == provider).select(*key).distinct(), key, "left_anti").withColumn("provider", F.lit(provider)).withColumn("review_status", F.lit("open"))

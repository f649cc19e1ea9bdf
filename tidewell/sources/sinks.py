"""Results as JSON lines and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.text import preview


def search_json(found: DataFrame) -> DataFrame:
    """(value): one JSON object for each hit of a search (doc_id, position, score, content), best first."""
    hit = F.struct("doc_id", F.round("score", 4).alias("score"), preview(F.col("content")).alias("preview"))
    return found.orderBy("position").select(F.to_json(hit).alias("value"))


def run_json(stats: dict[str, int]) -> str:
    """A consolidation's counts as one JSON object."""
    return json.dumps(stats, sort_keys=True, default=str)


def prune_report(stale: DataFrame, misaligned: DataFrame, most: int = 50) -> str:
    """What pruning would do, in Markdown: documents to remove, to flag and those whose hits score low; ``most`` of each."""
    parts = ["# Prune report"]
    for title, rows in (
        ("To remove", stale.where("action = 'remove'")),
        ("To flag", stale.where("action = 'flag'")),
        ("Misaligned", misaligned),
    ):
        total = rows.count()
        lines = [f"- `{r['doc_id']}`" for r in rows.select("doc_id").orderBy("doc_id").limit(most).collect()]
        more = [f"- and {total - most} more"] if total > most else []
        parts.append("\n".join([f"## {title} ({total})", *(lines or ["- none"]), *more]))
    return "\n\n".join(parts) + "\n"

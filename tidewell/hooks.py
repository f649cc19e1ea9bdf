"""What a host calls around a conversation: context at its start, memories for each message, nothing at its end."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewell.engine import Engine

LEAST_MESSAGE, HITS, SNIPPET, MOST_CONTEXT, MOST_HANDOFF = 5, 5, 200, 3000, 800


def clipped(text: str, most: int) -> str:
    """The text's first ``most`` bytes at most, whole characters."""
    data = text.encode()
    return text if len(data) <= most else data[:most].decode(errors="ignore")


def on_message(engine: Engine, message: str, now: datetime) -> str:
    """What is known about a message: snippets of its best hits. It is asked for every message and has no least score."""
    if len(message.encode()) < LEAST_MESSAGE:
        return ""
    out = ""
    for row in engine.search(message, now, limit=HITS).select("doc_id", F.substring("content", 1, SNIPPET).alias("snippet")).collect():
        line = f"- {row['doc_id']}: {' '.join((row['snippet'] or '').split())}\n"
        if len((out + line).encode()) > MOST_CONTEXT:
            break
        out += line
    return out


def on_start(engine: Engine, now: datetime) -> str:
    return clipped(engine.handoff() or "", MOST_HANDOFF)


def on_end(engine: Engine, now: datetime) -> None:
    """Nothing is kept that wasn't said."""

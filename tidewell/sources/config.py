"""Which folders are indexed: a list of sources from a TOML file.

    [[source]]
    name = "notes"
    path = "/data/notes"
    priority = "high"
"""

from __future__ import annotations

import os
import tomllib
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

PRIORITIES = ("high", "medium", "low")
#: The environment variable that names the file, where it is looked for otherwise, and what holds without any.
VARIABLE, DEFAULT_PATH = "TIDEWELL_SOURCES", "~/.config/tidewell/sources.toml"


@dataclass(frozen=True)
class Source:
    name: str
    path: str
    priority: str = "medium"

    def __post_init__(self) -> None:
        if not self.name or "::" in self.name or self.priority not in PRIORITIES:
            raise ValueError(f"source {self.name!r} of priority {self.priority!r}")


def parse(text: str) -> list[Source]:
    found = [Source(**{k: str(v) for k, v in entry.items()}) for entry in tomllib.loads(text).get("source", [])]
    if len({s.name for s in found}) < len(found):
        raise ValueError("two sources have one name")
    return found


def sources(override: str | None = None, built_in: Sequence[Source] = (), default: str = DEFAULT_PATH) -> list[Source]:
    """The sources of the file that ``override`` names, else the environment, else the default path; else the built-in ones.

    Ordered by priority. A file that was asked for must exist; the default one may be missing.
    """
    asked = override or os.environ.get(VARIABLE)
    place = Path(asked or default).expanduser()
    found = parse(place.read_text()) if asked or place.exists() else list(built_in)
    return sorted(found, key=lambda s: (PRIORITIES.index(s.priority), s.name))

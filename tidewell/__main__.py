"""``python -m tidewell --store PATH COMMAND``: the engine's operations from a shell."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from tidewell import tools
from tidewell.engine import Engine
from tidewell.session import get_session
from tidewell.sources import config, sinks

MOST_HITS = 100


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewell")
    top.add_argument("--store", required=True)
    top.add_argument("--sources", help="a TOML file of sources")
    made = top.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [made_one := made.add_parser(name), [made_one.add_argument(*names, **kind) for names, kind in args]][0]
    number = lambda name, default, kind=int: ((name,), {"type": kind, "default": default})
    flag = lambda name: ((name,), {"action": "store_true"})
    add("init")
    add("index", (("path",), {}), (("--source",), {}), flag("--chunks"))
    add("sync")
    add("search", (("query",), {}), number("--limit", 5), flag("--json"))
    add("recall", (("query",), {}), number("--limit", 5))
    add("remember", (("content",), {}), (("--category",), {"default": "events"}), number("--importance", 0.5, float), number("--ttl", None))
    add("memories", number("--limit", 20))
    add("forget", (("id",), {}))
    add("handoff", (("text",), {"nargs": "?"}), flag("--clear"))
    add("suggest", (("anchor",), {}), number("--limit", 5))
    add("stats")
    add("excitability", number("--limit", 10))
    add("graph")
    add("consolidate", flag("--dry-run"), flag("--report"))
    add("serve")
    return top


def run(argv: list[str], spark=None, now: datetime | None = None, out=sys.stdout) -> int:
    asked = parser().parse_args(argv)
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    engine = Engine(spark or get_session(), asked.store)
    say = lambda x: print(x, file=out)
    rows = lambda df: [say(r.asDict()) for r in df.collect()]
    listed = config.sources(asked.sources)
    match asked.command:
        case "init":
            say(engine.store.path)
        case "index":
            say(engine.index_chunks(asked.path, now) if asked.chunks else engine.index_path(asked.path, now, asked.source))
        case "sync":
            say(engine.consolidate(now, ("reindex",), listed))
        case "search":
            found = engine.search(asked.query, now, record=True, limit=max(1, min(asked.limit, MOST_HITS)))
            [say(r["value"]) for r in sinks.search_json(found).collect()] if asked.json else rows(found.select("doc_id", "score"))
        case "recall":
            rows(engine.recall(asked.query, now, asked.limit))
        case "remember":
            say(engine.remember(asked.content, asked.category, now, asked.importance, asked.ttl, title=60))
        case "memories":
            rows(engine.memories(asked.limit).select("id", "category", "title", "importance"))
        case "forget":
            engine.forget(asked.id)
        case "handoff":
            engine.clear_handoff(now) if asked.clear else engine.set_handoff(asked.text, now) if asked.text else say(engine.handoff() or "")
        case "suggest":
            rows(engine.suggest(asked.anchor, now, asked.limit))
        case "stats":
            for df in engine.stats(now).values():
                rows(df)
        case "excitability":
            rows(engine.store.read("documents").orderBy("excitability", "doc_id").select("doc_id", "excitability").limit(asked.limit))
        case "graph":
            say(engine.build_graph(now))
        case "consolidate":
            if asked.report:
                say(sinks.prune_report(*engine.prune_candidates(now, listed)))
            else:
                say(sinks.run_json(engine.consolidate(now, sources=listed, dry_run=asked.dry_run)))
        case "serve":
            tools.serve(engine, sys.stdin.buffer, sys.stdout.buffer, lambda: datetime.now(timezone.utc).replace(tzinfo=None))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))

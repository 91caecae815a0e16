"""Command line: index, search, view, embed, ask, patterns, summarize."""

from __future__ import annotations

import argparse
import json
import os
import sys

from threadlake.engine import Engine
from threadlake.operators.mining import report_markdown, write_report
from threadlake.plans.ingest import IndexConfig, view_file
from threadlake.session import get_session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="threadlake")
    p.add_argument("--root", default=os.path.expanduser("~/.threadlake"))
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index", aliases=["i"])
    for name in ("claude", "desktop", "cursor", "opencode", "codex", "history", "plan-archive"):
        a.add_argument(f"--{name}")
    a.add_argument("--plans", nargs="*", default=[])
    a.add_argument("--cursor-plans", nargs="*", default=[])
    depth = a.add_mutually_exclusive_group()
    depth.add_argument("--quick", action="store_true")
    depth.add_argument("--deep", action="store_true")
    a.add_argument("--force", action="store_true")
    a = sub.add_parser("search")
    a.add_argument("query", nargs="+")
    how = a.add_mutually_exclusive_group()
    how.add_argument("--fuzzy", action="store_true")
    how.add_argument("--semantic", action="store_true")
    for name in ("vendor", "project"):
        a.add_argument(f"--{name}")
    a.add_argument("--since", default="")
    a.add_argument("--limit", type=int)
    a.add_argument("--json", action="store_true")
    a = sub.add_parser("view", aliases=["v"])
    a.add_argument("path")
    a = sub.add_parser("embed")
    a.add_argument("--force", action="store_true")
    a = sub.add_parser("ask")
    a.add_argument("question", nargs="+")
    a = sub.add_parser("patterns")
    a.add_argument("--top", type=int)
    a.add_argument("--out")
    a.add_argument("--json", action="store_true")
    a = sub.add_parser("summarize")
    a.add_argument("session")
    a.add_argument("--refresh", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "search" and (args.vendor or args.project) and not args.semantic:
        print("--vendor and --project need --semantic", file=sys.stderr)
        return 2
    engine = Engine(get_session(), args.root)
    show = lambda df: print("\n".join(df.toJSON().collect()))
    if args.command in {"index", "i"}:
        config = IndexConfig(args.claude, args.desktop, args.cursor, args.opencode, args.codex, args.history, args.plans, args.cursor_plans, args.plan_archive)
        stats = engine.index(config, not args.quick, args.force)
        print(json.dumps(vars(stats)))
        return 1 if stats.failed else 0
    if args.command == "search":
        query = " ".join(args.query)
        show(engine.semantic_search(query, args.limit, args.vendor, args.project, args.since) if args.semantic else engine.search_history(query, args.limit, args.fuzzy, args.since))
    elif args.command in {"view", "v"}:
        show(view_file(engine.spark, args.path)[1].orderBy("session_id", "seq"))
    elif args.command == "embed":
        print(engine.embed(args.force))
    elif args.command == "ask":
        hits, answer = engine.ask_history(" ".join(args.question))
        print(answer or "\n".join(json.dumps(h.asDict(), default=str) for h in hits))
    elif args.command == "patterns":
        skills, scripts = engine.mine_patterns(args.top)
        if args.out:
            print("\n".join(write_report(skills, scripts, args.out)))
        elif args.json:
            print(json.dumps({"skills": [s.asDict() for s in skills], "scripts": [s.asDict() for s in scripts]}, default=str))
        else:
            print(report_markdown(skills, scripts))
    elif args.command == "summarize":
        show(engine.summarize_session(args.session, args.refresh))
    return 0


if __name__ == "__main__":
    sys.exit(main())

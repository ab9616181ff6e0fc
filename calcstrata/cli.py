"""Command line: version, init, add, commit, log, diff, status, reproduce, plugin."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .operators import facts, render
from .schemas import RepositoryError
from .session import session
from .sources.repository import Repository

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="calcstrata")
    top.add_argument("-C", "--root", default=".")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    p = sub.add_parser("init")
    p.add_argument("--force", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p = sub.add_parser("add")
    p.add_argument("paths", nargs="*")
    for flag in ("--force", "--dry-run", "--no-validate"):
        p.add_argument(flag, action="store_true")
    p = sub.add_parser("commit")
    p.add_argument("-m", "--message", required=True)
    p.add_argument("-a", "--all", action="store_true")
    p.add_argument("--allow-empty", action="store_true")
    p.add_argument("--author")
    p = sub.add_parser("log")
    p.add_argument("-n", "--max-count", type=int)
    p.add_argument("--oneline", action="store_true")
    p.add_argument("--format", choices=("default", "oneline", "json"), default="default")
    p = sub.add_parser("diff")
    p.add_argument("rev1", nargs="?")
    p.add_argument("rev2", nargs="?")
    p.add_argument("--format", choices=("semantic", "compact", "detailed", "unified", "json"), default="semantic")
    p.add_argument("--summary", action="store_true")
    p.add_argument("--file")
    p = sub.add_parser("status")
    p.add_argument("--short", action="store_true")
    p = sub.add_parser("reproduce")
    p.add_argument("rev")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--verify-potcar", action=argparse.BooleanOptionalAction, default=True, help="compare the hashes of what was written")
    p.add_argument("--verify-env", action=argparse.BooleanOptionalAction, default=False, help="compare the recorded environment with this one")
    p = sub.add_parser("plugin")
    p.add_argument("action", choices=("list", "info", "enable", "disable"))
    p.add_argument("name", nargs="?")
    return top


def run(argv: list[str], spark=None) -> str:
    """The command's output; RepositoryError if it cannot be carried out."""
    a = parser().parse_args(argv)
    if a.command == "version":
        return VERSION
    repo = Repository(spark or session("local[*]"), a.root)
    if a.command == "init":
        repo.init(a.force)
        return "" if a.quiet else f"Repository in {repo.root}"
    if a.command == "add":
        rows = repo.add(a.paths, a.force, a.dry_run, not a.no_validate).orderBy("path").collect()
        return "\n".join(f"{r['status']:8} {r['path']} ({r['file_type']})" for r in rows)
    if a.command == "commit":
        return repo.commit(a.message, a.author, a.all, a.allow_empty)
    if a.command == "log":
        history = repo.log(a.max_count)
        if a.format == "json":
            return "[" + ",".join(r["json"] for r in render.as_json(history).collect()) + "]"
        oneline = a.oneline or a.format == "oneline"
        text = render.history_text(history, oneline).orderBy(F.desc("timestamp"), "commit_hash")
        return ("\n" if oneline else "\n\n").join(r["text"] for r in text.collect())
    if a.command == "diff":
        if a.format == "unified" and not a.summary:
            return "\n".join(r["text"] for r in repo.unified(a.rev1, a.rev2, a.file).orderBy("file").collect()) or "No changes"
        entries = repo.diff(a.rev1, a.rev2, a.file)
        if a.summary:
            return "\n".join(str(r.asDict()) for r in facts.summarize(entries, ["file"]).orderBy("file").collect())
        if a.format == "json":
            return "[" + ",".join(r["json"] for r in render.as_json(entries.orderBy("file", "ord", "path")).collect()) + "]"
        style = {"semantic": "default"}.get(a.format, a.format)
        rows = render.diff_lines(entries, style).orderBy("file").collect()
        return "\n".join(f"{r['file']}\n{r['text']}" for r in rows) or "No changes"
    if a.command == "status":
        rows = repo.status().collect()
        return "\n".join(f"{r['mark']} {r['path']}" if a.short else f"{r['mark']} {r['path']} {r['file_type']} {r['size']}" for r in rows)
    if a.command == "reproduce":
        rows = repo.reproduce(a.rev, a.output, a.verify_potcar).orderBy("path").collect()
        out = [f"{r['status']:8} {r['path']}" for r in rows]
        if a.verify_env:
            told = repo.environment(a.rev).orderBy("name").collect()
            out += [f"{'ok' if r['matches'] else 'differs':8} {r['name']}: {r['stored'] or '-'} / {r['current']}" for r in told]
        if any(r["status"] not in ("ok", "written") for r in rows):
            raise RepositoryError("\n".join(out))
        return "\n".join(out)
    if a.action == "info":
        own = [v for v in repo.validators() if v["name"] == a.name]
        if not own:
            raise RepositoryError(f"no validator is called {a.name}")
        return "\n".join(f"{k}: {v}" for k, v in (own[0] | {"settings": repo.manager().config(a.name)}).items())
    if a.action in ("enable", "disable"):
        repo.set_validator(a.name, a.action == "enable")
    out = [f"{v['priority']:3} {v['name']} {'on' if v['enabled'] else 'off'}" for v in repo.validators() if a.name in (None, v["name"])]
    out += [f"  - {p['name']} parser" for p in repo.manager().parsers() if a.name in (None, p["name"])]
    return "\n".join(out)


def main() -> int:
    try:
        print(run(sys.argv[1:]))
    except RepositoryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

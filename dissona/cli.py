"""Commands on a workspace: python -m dissona.cli --workspace DIR COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

COMMANDS = {
    "init": [],
    "ingest": ["folder", "corpus"],
    "check": ["corpus"],
    "estimate-cost": ["corpus"],
    "report": ["?run"],
    "export": ["format", "path"],
    "eval": ["?corpus"],
    "stats": [],
    "corpora": [],
    "rebuild-index": [],
    "rename": ["corpus", "new"],
    "delete": ["corpus"],
    "reassign": ["where", "corpus"],
    "clear-stuck": ["corpus"],
    "orphans": [],
    "active-corpus": ["?corpus"],
    "compare-baseline": ["runs", "labels"],
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dissona", description=__doc__)
    p.add_argument("--workspace", required=True)
    p.add_argument("--config", help="a file of name: value lines")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a.lstrip("?"), **({"nargs": "?"} if a[0] == "?" else {}))
        if name in ("check", "estimate-cost"):
            c.add_argument("--org-scope", action=argparse.BooleanOptionalAction, help="compare definitions within each organisation only")
        if name == "delete":
            c.add_argument("--yes-i-mean-it", action="store_true")
    return p


def main(arguments: list[str] | None = None, spark=None) -> int:
    """Runs a command; what it says goes to standard output. Errors that a user can mend give 2."""
    from dissona.plans import harness, plugins
    from dissona.plans.workspace import Workspace
    from dissona.runtime import preflight_memory
    from dissona.sources import sinks
    from dissona.sources.readers import Config

    a = parser().parse_args(arguments)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("dissona").getOrCreate()
    config = Config.read(open(a.config).read() if a.config else "")
    if getattr(a, "org_scope", None) is not None:
        config = replace(config, scope_definitions_by_org=a.org_scope)
    w = Workspace(spark, a.workspace)
    new = w.migrate()
    show = lambda df: print("\n".join(str(r.asDict()) for r in df.collect()))  # noqa: E731  a few rows each
    try:
        match a.command:
            case "init":
                print(f"changes applied: {new}")
            case "ingest":
                print(w.ingest(a.folder, a.corpus, config=config))
            case "check":
                if warning := preflight_memory(config.max_memory_mb):
                    print(f"warning: {warning}", file=sys.stderr)
                if message := w.warning(a.corpus, config):
                    print(message, file=sys.stderr)
                print(w.check(a.corpus, judge=plugins.make_judge(config.judge_provider, {"fixture": lambda: plugins.FixtureJudge({})}), config=config))
            case "estimate-cost":
                show(w.estimate(a.corpus, config))
            case "report":
                print(w.report(a.run))
            case "export":
                if a.format == "csv":
                    sinks.write_csv(sinks.assertion_export(w.read("assertions")), a.path)
                elif a.format == "jsonl":
                    sinks.write_lines(sinks.assertion_lines(w.read("assertions"), w.read("documents")), a.path)
                else:
                    raise ValueError("the format is csv or jsonl")
            case "eval":
                show(sinks.precision_rows(w.precision(a.corpus)))
            case "stats":
                show(w.stats())
            case "corpora":
                show(w.sidebar().orderBy("corpus_name"))
            case "rebuild-index":
                print(w.rebuild_index(plugins.HashEmbedder()))
            case "rename":
                w.rename_corpus(a.corpus, a.new)
            case "delete":
                w.delete_corpus(a.corpus, sure=a.yes_i_mean_it)
            case "reassign":
                w.reassign(a.where, a.corpus)
            case "clear-stuck":
                print(w.clear_stuck(a.corpus))
            case "orphans":
                show(w.orphans())
            case "active-corpus":
                print(w.active_corpus(a.corpus) or "none")
            case "compare-baseline":
                print(harness.compare_baseline(spark, a.runs, a.labels))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())

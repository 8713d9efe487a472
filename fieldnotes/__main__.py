"""The command line: init, inspect, stats and run over a project folder."""

from __future__ import annotations

import argparse
import importlib
from dataclasses import replace

from pyspark.sql import SparkSession

from .config import DEFAULT
from .plans import pipeline
from .sources import extractor


def _plugin(name: str | None):
    """module:attribute, or None."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fieldnotes", description="Interview evidence from transcripts.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("--project", default=".", help="the folder of the transcripts")
        return p

    p = command("init", "write metadata.csv with the speakers found, unless it is there")
    p.add_argument("--overwrite", action="store_true")
    command("inspect", "show the transcripts' speakers")
    stats, run = command("stats", "statistics over the outputs of an earlier run"), command("run", "the whole analysis")
    for p in (stats, run):
        p.add_argument("--output-dir", default=None, help="the outputs folder; by default the project's, or its latest one")
        p.add_argument("--bootstrap-reps", type=int, default=DEFAULT.bootstrap_reps)
        p.add_argument("--top-terms", type=int, default=DEFAULT.top_terms)
        p.add_argument("--no-charts", action="store_true", help="skip the tables of the charts")
    run.add_argument("--server", help="address of a local chat server; without one and without a plug-in the rules of this library extract")
    run.add_argument("--model", default="", help="the server's model")
    run.add_argument("--num-ctx", type=int, default=32768, help="the model's context window")
    run.add_argument("--extractor", help="module:attribute of a function that makes a client")
    run.add_argument("--embedder", help="module:attribute of a function that makes an embedder")
    run.add_argument("--redactor", help="module:attribute of a function that makes a redactor")
    run.add_argument("--writer", help="module:attribute of a function that writes the synthesis")
    run.add_argument("--max-chars", type=int, default=DEFAULT.max_chars)
    run.add_argument("--overlap-turns", type=int, default=DEFAULT.overlap_turns)
    run.add_argument("--limit-chunks", type=int, default=None, help="for a cheap trial")
    run.add_argument("--parse-only", action="store_true")
    run.add_argument("--no-redact", action="store_true")
    run.add_argument("--no-embedding-clusters", action="store_true", help="themes by label, even with an embedder")
    run.add_argument("--no-report", action="store_true", help="skip the synthesis")
    run.add_argument("--no-stats", action="store_true")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("fieldnotes").getOrCreate()
    if a.command == "init":
        print("metadata.csv written" if pipeline.init(spark, a.project, a.overwrite) else "metadata.csv is there already")
        return
    if a.command == "inspect":
        speakers, errors = pipeline.inspect(spark, a.project)
        last = None
        for r in speakers.collect():  # names of one project's speakers
            if r["file_name"] != last:
                last = r["file_name"]
                print(last)
            print(f"  - {r['speaker']}")
        for r in errors.collect():
            print(f"{r['file_name']}: {r['error']}")
        return
    config = replace(DEFAULT, bootstrap_reps=a.bootstrap_reps, top_terms=a.top_terms)
    if a.command == "stats":
        print(pipeline.stats(spark, a.project, a.output_dir, config, charts=not a.no_charts).report)
        return
    config = replace(config, max_chars=a.max_chars, overlap_turns=a.overlap_turns)
    client = _plugin(a.extractor) or (extractor.chat_client(a.server, a.model, a.num_ctx) if a.server else None)
    writer = _plugin(a.writer) or (extractor.chat(a.server, a.model, a.num_ctx, "Write a report about this evidence packet.") if a.server else None)
    plugins = pipeline.Plugins(client, _plugin(a.redactor), None if a.no_embedding_clusters else _plugin(a.embedder), None if a.no_report else writer)
    done = pipeline.run(spark, a.project, a.output_dir, config, plugins, parse_only=a.parse_only, limit=a.limit_chunks, redact=not a.no_redact, with_stats=not a.no_stats, charts=not a.no_charts)
    print(done.report or f"tables: {', '.join(sorted(done.tables))}")


if __name__ == "__main__":
    main()

"""Command line: index, map, find, show, refs, outline and stats of a tree; report on run records.

Exit codes: 0 done, 1 nothing matched, 2 error.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.operators import display as D
from symgrid.operators import experiments as E
from symgrid.sources import store


def _session() -> SparkSession:
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8"}
    return SparkSession.builder.master(os.environ.get("SYMGRID_MASTER", "local[*]")).config(map=conf).getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="symgrid")
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "map", "find", "show", "refs", "outline", "stats"):
        c = sub.add_parser(name)
        c.add_argument("--json", action="store_true")
        c.add_argument("--refresh", action="store_true")
        if name in ("find", "show", "refs", "outline"):
            c.add_argument("name")
        if name != "index":
            c.add_argument("--budget", type=int, default=2000 if name == "map" else 800)
        if name in ("index", "map"):
            c.add_argument("--focus", action="append", default=[])
        if name == "index":
            c.add_argument("--force", action="store_true")
            c.add_argument("--rank", choices=("simple", "pagerank"))
        if name == "find":
            c.add_argument("--limit", type=int, default=D.FIND_LIMIT)
            c.add_argument("--all", action="store_true")
    t = sub.add_parser("tasks")
    t.add_argument("folder")
    t.add_argument("--repo")
    t.add_argument("--category", default="")
    sub.add_parser("context").add_argument("--budget", type=int, default=2000)
    r = sub.add_parser("report")
    r.add_argument("results")
    r.add_argument("--json", action="store_true")
    return p


def acquire(spark: SparkSession, root: str, refresh: bool = False) -> store.Index:
    """The stored index, built if there is none and refreshed if asked for."""
    home = os.path.join(root, store.HOME)
    index = store.load(spark, home)
    if index is None or refresh:
        if index is None:
            print("building the index", file=sys.stderr)
        new, _ = store.build(spark, root, index.strategy if index else "simple", index.focus if index else (), index)
        store.save(new, home)
        index = store.load(spark, home)
    assert index is not None
    return index


def _lines(spark: SparkSession, lines: DataFrame, order: list[str], budget: int) -> str:
    """Ordered lines within the budget, as text."""
    rows = D.numbered(lines, [F.col(c) for c in order], "pos_all").select("content", F.col("pos_all").alias("pos"))
    return "\n".join(r["content"] for r in D.fitted(rows, budget).orderBy("pos").toLocalIterator())


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not os.path.isdir(args.root):
        print(f"not a directory: {args.root}", file=sys.stderr)
        return 2
    try:
        return _run(_session(), args)
    except (ValueError, OSError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 2


def context(files: DataFrame, defs: DataFrame, text: DataFrame, budget: int) -> DataFrame:
    """One row: what showing one definition of each name costs against its file, and a map against everything.

    A file that can't be read any more is left out rather than counted as free.
    """
    cut = F.split("text", "\n")
    first = E.first_of_each_name(defs).join(text, "path")
    span = F.array_join(F.slice(cut, F.col("line"), F.greatest(F.least("end_line", F.size(cut)) - F.col("line") + 1, F.lit(0))), "\n")
    probed = E.probe(first.select("name", D.X.token_count(span).alias("show_tokens"), D.X.token_count("text").alias("file_tokens")))
    chosen = D.mapped(files, defs, budget)
    spent = chosen.agg(F.coalesce(F.max("used") + F.max(F.when(F.col("truncated"), D.MARKER_COST + 1).otherwise(0)), F.lit(0)).alias("map_tokens"))
    whole = text.agg(F.coalesce(F.sum(D.X.token_count("text")), F.lit(0)).alias("repo_tokens"), F.count("*").alias("files"))
    return E.probe_summary(probed).crossJoin(spent).crossJoin(whole)  # one row each


def _show(rows: DataFrame) -> None:
    for row in rows.toJSON().toLocalIterator():
        print(json.dumps(json.loads(row), sort_keys=True))


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "report":
        from symgrid.sources.records import load_runs

        runs = load_runs(spark, args.results).withColumns({"ts": F.col("started_at"), "event_id": F.monotonically_increasing_id()})
        runs = runs.withColumn("tool_calls", F.array_sort(F.map_entries("tool_calls")).cast("string"))
        tasks = E.task_summaries(runs)
        for block in (E.headline(tasks), E.arms_block(runs), E.by_category(tasks), E.integrity(runs), E.prompt_overhead(runs), tasks):
            _show(block)
        return 0
    if args.command == "tasks":
        from symgrid.sources.records import load_tasks

        for row in load_tasks(spark, args.folder, args.repo, args.category).toLocalIterator():
            print(f"{row['id']:<32} {row['repo']:<12} {row['category']}  {row['grade']['kind']}")
        return 0
    home = os.path.join(args.root, store.HOME)
    if args.command == "index":
        prior = store.load(spark, home)
        strategy = args.rank or (prior.strategy if prior else "simple")
        focus = tuple(args.focus) or (prior.focus if prior else ())
        index, plan = store.build(spark, args.root, strategy, focus, None if args.force else prior)
        counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}  # before the old tables go
        store.save(index, home)
        print(f"indexed {args.root}: {counts.get('parse', 0)} parsed, {counts.get('reuse', 0)} reused, {counts.get('drop', 0)} dropped")
        return 0
    index = acquire(spark, args.root, getattr(args, "refresh", False))
    files, defs, refs = index.files, index.defs, index.refs
    if args.command == "context":
        text = store.listed(spark, args.root).join(files.select("path"), "path", "left_semi").select("path", F.col("content").cast("string").alias("text"))
        _show(context(files, defs, text, args.budget))
        return 0
    if args.command == "map":
        chosen = D.mapped(files, defs, args.budget, args.focus or index.focus)
        if args.json:
            _show(chosen.select("path", "loc", "rank", "name", "kind", "line", "depth", "truncated").orderBy("path", "line"))
        else:
            rows = [r["content"] for r in D.map_lines(chosen).orderBy("file_no", "pos").toLocalIterator()]
            if chosen.where("truncated").head(1) or not rows and defs.head(1):
                rows.append(D.MARKER)
            print("\n".join(rows))
        return 0
    if args.command == "find":
        hits = D.search(files, defs, args.name, args.limit)
        if not hits.head(1):
            print(f"no symbol matches {args.name!r}")
            return 1
        shown = D.shown_hits(hits, args.all)
        if args.json:
            _show(shown.orderBy("place"))
            return 0
        lines = shown.select("place", D.X.hit_text().alias("content"))
        s = D.partial_summary(hits, args.limit).first()
        if not args.all and s["n_exact"] and s["n_partial"]:
            more = f"+ {'at least ' if s['capped'] else ''}{s['n_partial']} partial match{'es' if s['n_partial'] > 1 else ''} in {s['n_files']} file{'s' if s['n_files'] > 1 else ''} (list with --all)"
            lines = lines.unionByName(spark.createDataFrame([(1 << 30, more)], "place int, content string"))
        print(_lines(spark, lines, ["place"], args.budget))
        return 0
    if args.command in ("show", "refs"):
        wanted = spark.createDataFrame([(args.name,)], "wanted string")
        found = D.definitions(files, defs, wanted)
        if args.command == "show":
            if not found.head(1):
                near = D.suggestions(files, defs, args.name).first()["suggestions"]
                print(f"no symbol {args.name!r}" + (f"; close to it: {near}" if near else ""))
                return 1
            text = store.listed(spark, args.root).join(found.select("path").distinct(), "path", "left_semi").select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n"))).select("path", (F.col("pos") + 1).alias("line"), F.col("col").alias("content"))
            heads = found.where(F.col("place") <= D.SHOWN).select("place", F.lit(0).alias("line_no"), F.format_string("%s:%d-%d %s %s", "path", "line", "end_line", "kind", "name").alias("content"))
            print(_lines(spark, heads.unionByName(D.spans(found, text).select("place", "line_no", "content")), ["place", "line_no"], args.budget))
            more = found.count() - D.SHOWN
            if more > 0:
                print(f"({more} more not shown)")
            return 0
        sites = D.referrers(files, refs, args.name)
        if not found.head(1) and not sites.head(1):
            print(f"{args.name!r} is neither defined nor referred to")
            return 1
        own = found.select(F.lit(0).alias("part"), F.col("place").cast("long").alias("place"), F.format_string("defined: %s:%d %s", "path", "line", "signature").alias("content"))
        used = sites.select(F.lit(1).alias("part"), "place", F.format_string("used: %s:%s (%s)", "path", "lines", "kinds").alias("content"))
        print(_lines(spark, own.unionByName(used), ["part", "place"], args.budget))
        return 0
    if args.command == "outline":
        row = D.resolved_paths(files, spark.createDataFrame([(args.name,)], "wanted string")).first()
        if row["path"] is None:
            print(f"{args.name!r} " + (f"is the end of {row['n_candidates']} paths" if row["n_candidates"] else "isn't indexed"))
            return 1
        print(_lines(spark, D.outline(files, defs, row["path"]), ["pos"], args.budget))
        return 0
    _show(D.stats(files, defs).orderBy("section", F.desc("n"), "name"))
    _show(D.top_files(files).orderBy("place"))
    return 0


if __name__ == "__main__":
    sys.exit(main())

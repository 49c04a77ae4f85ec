"""The stored index: Parquet tables, JSON interchange, and refreshing by content hash."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.operators.experiments import refresh_plan
from symgrid.operators.resolve import STRATEGIES, ranks, with_ranks
from symgrid.schemas import DEFS, FILES, INDEX_VERSION, META, REFS
from symgrid.sources import walk
from symgrid.sources.parse import parsed_files

HOME = ".symgrid"


@dataclass
class Index:
    """Tables of one tree."""

    root: str
    files: DataFrame
    defs: DataFrame
    refs: DataFrame
    strategy: str = "simple"
    focus: tuple[str, ...] = ()


def listed(spark: SparkSession, root: str, max_bytes: int = walk.MAX_BYTES, max_files: int = walk.MAX_FILES) -> DataFrame:
    """(path, content, sha256) of the readable files of a tree; each is read once, so hash and content agree."""
    if "symgrid_repo" not in _registered:
        spark.dataSource.register(walk.RepoSource)
        _registered.add("symgrid_repo")
    listing = spark.read.format("symgrid_repo").load(root)
    rules = walk.ignore_files(root)
    kept = walk.kept_files(listing, walk.ignore_rules(spark, rules) if rules else None, max_bytes, max_files).select("path")
    base = os.path.abspath(root)

    def read(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    rows.append((path, Path(base, path).read_bytes()))
                except OSError:  # vanished since it was listed
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "content"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartition(parts, "path").mapInArrow(read, "path string, content binary").withColumn("sha256", F.sha2("content", 256))


_registered: set[str] = set()


def build(spark: SparkSession, root: str, strategy: str = "simple", focus: Sequence[str] = (), prior: Index | None = None) -> tuple[Index, DataFrame]:
    """The index of a tree as it is now, and the plan (path, action) by which ``prior`` was used.

    Files whose hash is stored keep their parsed rows, others are parsed, vanished ones are gone;
    ranks are always those of the whole.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown rank strategy {strategy!r}; expected one of {', '.join(STRATEGIES)}")
    now = listed(spark, root)
    if prior is None:
        plan = now.select("path", F.lit("parse").alias("action"))
        new = now
    else:
        plan = refresh_plan(prior.files.select("path", "sha256"), now.select("path", "sha256"))
        new = now.join(prior.files.select("path", "sha256"), ["path", "sha256"], "left_anti")
    from symgrid.plans.storage import kept

    parsed = kept(parsed_files(new).join(new.select("path", "sha256"), "path"), "parsed")
    files = parsed.select("path", "sha256", "language", "loc", "truncated")
    defs, refs = (parsed.select("path", F.inline(c)) for c in ("defs", "refs"))
    if prior is not None:
        same = prior.files.join(now.select("path", "sha256"), ["path", "sha256"], "left_semi")
        files = files.unionByName(same.select(*files.columns))
        defs = defs.unionByName(prior.defs.join(same.select("path"), "path", "left_semi").select(*defs.columns))
        refs = refs.unionByName(prior.refs.join(same.select("path"), "path", "left_semi").select(*refs.columns))
    files = with_ranks(files, ranks(files, defs, refs, strategy, focus)).select("path", "sha256", "rank", "language", "loc", "truncated")
    return Index(str(root), files, defs, refs, strategy, tuple(focus)), plan


def save(index: Index, home: str) -> None:
    """Write all tables beside the old ones and put them in place; readers see one state or the other."""
    spark = index.files.sparkSession
    new = f"{home}.new"
    shutil.rmtree(new, ignore_errors=True)
    for name in ("files", "defs", "refs"):
        getattr(index, name).write.parquet(f"{new}/{name}")
    spark.createDataFrame([(INDEX_VERSION, index.root, index.strategy, list(index.focus))], META).coalesce(1).write.json(f"{new}/meta")
    shutil.rmtree(home, ignore_errors=True)
    os.rename(new, home)


def load(spark: SparkSession, home: str) -> Index | None:
    """A stored index; None if it is missing, damaged, of another version or of an unknown strategy."""
    try:
        meta = spark.read.schema(META).json(f"{home}/meta").first()
        if meta is None or meta["schema"] != INDEX_VERSION or meta["rank_strategy"] not in STRATEGIES:
            return None
        tables = {n: spark.read.schema(s).parquet(f"{home}/{n}") for n, s in (("files", FILES), ("defs", DEFS), ("refs", REFS))}
        for table in tables.values():
            table.head(1)
    except Exception:  # whatever is wrong with it, the answer is to build it anew
        return None
    return Index(meta["root"], tables["files"], tables["defs"], tables["refs"], meta["rank_strategy"], tuple(meta["focus"] or ()))


def nested(index: Index) -> DataFrame:
    """(path, entry): one JSON object a file with sorted keys, the interchange form."""
    d = index.defs.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "name", "kind", "doc", "end_line", "exported", "signature"))).alias("d"))
    r = index.refs.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "name", "kind"))).alias("r"))
    rows = index.files.join(d, "path", "left").join(r, "path", "left")
    defs = F.transform(F.coalesce("d", F.array().cast(d.schema["d"].dataType)), lambda x: F.struct(*(x[c].alias(c) for c in ("doc", "end_line", "exported", "kind", "line", "name", "signature"))))
    refs = F.transform(F.coalesce("r", F.array().cast(r.schema["r"].dataType)), lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "line", "name"))))
    return rows.select("path", F.to_json(F.struct(defs.alias("defs"), "language", "loc", "rank", refs.alias("refs"), "sha256", "truncated")).alias("entry"))


def export_json(index: Index, path: str) -> None:
    """The whole index as one JSON document with sorted keys, read from Spark file by file."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    files = {r["path"]: json.loads(r["entry"]) for r in nested(index).orderBy("path").toLocalIterator()}
    document = {"files": files, "focus": list(index.focus), "rank_strategy": index.strategy, "root": index.root, "schema": INDEX_VERSION}
    Path(path).write_text(json.dumps(document, indent=2, sort_keys=True), encoding="utf-8")


def import_json(spark: SparkSession, path: str) -> Index | None:
    """An index from its JSON document; None if it isn't one of this version."""
    try:
        document = json.loads(Path(path).read_text(encoding="utf-8"))
        if document["schema"] != INDEX_VERSION or document["rank_strategy"] not in STRATEGIES:
            return None
        files = [(p, e["sha256"], float(e["rank"]), e["language"], e["loc"], e["truncated"]) for p, e in document["files"].items()]
        defs = [(p, *(x[c] for c in ("name", "kind", "line", "end_line", "signature", "doc", "exported"))) for p, e in document["files"].items() for x in e["defs"]]
        refs = [(p, x["name"], x["kind"], x["line"]) for p, e in document["files"].items() for x in e["refs"]]
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return None
    return Index(document["root"], spark.createDataFrame(files, FILES), spark.createDataFrame(defs, DEFS), spark.createDataFrame(refs, REFS), document["rank_strategy"], tuple(document.get("focus", ())))

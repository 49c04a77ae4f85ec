"""Repository listings: what of a tree is read, with ignore rules and caps."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from symgrid.functions.text import looks_binary
from symgrid.schemas import LISTING

SKIPPED_DIRS = ("__pycache__", ".git", ".venv", "build", "dist", "node_modules", "vendor", "venv", ".symgrid")
SKIPPED_NAMES = (
    "Cargo.lock", "Gemfile.lock", "Pipfile.lock", "Podfile.lock", "composer.lock", "flake.lock", "go.sum", "mix.lock", "npm-shrinkwrap.json", "package-lock.json",
    "pnpm-lock.yaml", "poetry.lock", "uv.lock", "yarn.lock",
)
MAX_BYTES, MAX_FILES, MAX_ENTRIES, SNIFFED = 1_000_000, 50_000, 500_000, 8192


def ignore_regex(pattern: str) -> tuple[str, bool, bool] | None:
    """(regex on a path relative to the file's folder, negated, folders only) of an ignore line; None for a comment."""
    line = pattern.rstrip("\n").rstrip("\r")
    if not line.endswith("\\ "):
        line = line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith("\\") else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.removeprefix("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
            while line.startswith("*", i):
                i += 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            body = line[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$", negated, folder


def ignore_rules(spark: SparkSession, texts: Iterable[tuple[str, str]]) -> DataFrame:
    """(dir, ord, regex, negated, folder) of the ignore files given as (dir, text); the top folder is empty."""
    rows = []
    for folder, text in texts:
        for number, line in enumerate(text.splitlines()):
            if rule := ignore_regex(line):
                rows.append((folder, number, *rule))
    return spark.createDataFrame(rows, "dir string, ord int, regex string, negated boolean, folder boolean")


def ignored_paths(listing: DataFrame, rules: DataFrame) -> DataFrame:
    """(path) that some rule file ignores, itself or by a folder it lies in.

    Each rule file speaks for its own folder and the last matching line of it decides; a deeper
    file can't take back what a higher one ignores. Paths and rules meet by folder.
    """
    steps = F.split("path", "/")
    own = listing.select("path", "is_dir", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("k", "part"), F.size(steps).alias("n"))
    own = own.select("path", "part", (F.col("is_dir") | (F.col("k") + 1 < F.col("n"))).alias("part_dir"))
    parts = F.split("part", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    pairs = own.select("path", "part", "part_dir", F.explode(dirs).alias("dir"))
    relative = F.when(F.col("dir") == "", F.col("part")).otherwise(F.expr("substring(part, char_length(dir) + 2)"))
    hits = pairs.join(rules, "dir").withColumn("_rel", relative).where("(part_dir or not folder) and _rel rlike regex")
    verdict = hits.groupBy("path", "part", "dir").agg(F.max_by(~F.col("negated"), "ord").alias("out"))
    return verdict.where("out").select("path").distinct()


def kept_files(listing: DataFrame, rules: DataFrame | None = None, max_bytes: int = MAX_BYTES, max_files: int | None = MAX_FILES) -> DataFrame:
    """Readable text files of a listing, in walk order: no links, skipped names, ignored, large or binary files."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    folders = F.split(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/")
    plain = listing.where(~F.col("is_dir") & ~F.col("is_link") & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_DIRS))))
    plain = plain.where(~name.isin(*SKIPPED_NAMES) & ~F.endswith(name, F.lit(".min.js")) & (F.col("size") <= max_bytes) & ~looks_binary("head", SNIFFED))
    if rules is not None:
        plain = plain.join(ignored_paths(plain.select("path", "is_dir"), rules), "path", "left_anti")
    # Segments compare one by one, so this order is that of a walk by name.
    return plain.orderBy(F.split("path", "/")).limit(max_files) if max_files is not None else plain


def walked(root: str | os.PathLike, max_entries: int = MAX_ENTRIES) -> Iterator[tuple[str, bool, bool, int, bytes]]:
    """Rows of a listing, depth first by name; skipped folders and linked ones aren't entered."""
    seen = 0

    def visit(folder: Path, prefix: str) -> Iterator[tuple[str, bool, bool, int, bytes]]:
        nonlocal seen
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for entry in entries:
            if seen >= max_entries:
                return
            seen += 1
            path, link = prefix + entry.name, entry.is_symlink()
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in SKIPPED_DIRS:
                    yield path, True, link, 0, b""
                    yield from visit(Path(entry.path), path + "/")
            elif link or entry.is_file(follow_symlinks=False):
                head, size = None, 0
                if not link:
                    try:
                        size = entry.stat(follow_symlinks=False).st_size
                        with open(entry.path, "rb") as f:
                            head = f.read(SNIFFED)
                    except OSError:
                        head = None
                yield path, False, link, size, head

    yield from visit(Path(root), "")


class RepoSource(DataSource):
    """``spark.read.format("symgrid_repo").load(root)``: the listing of a tree, one partition a top entry."""

    @classmethod
    def name(cls) -> str:
        return "symgrid_repo"

    def schema(self):  # noqa: ANN201
        return LISTING

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _RepoReader(self.options)


class _RepoReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options.get("path", ".")
        self.entries = int(options.get("max_entries", MAX_ENTRIES))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.root)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from walked(partition.value, self.entries)


def ignore_files(root: str | os.PathLike) -> list[tuple[str, str]]:
    """(folder, text) of every ignore file of a tree."""
    found = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED_DIRS and not os.path.islink(os.path.join(folder, d)))
        if ".gitignore" in names:
            relative = os.path.relpath(folder, root)
            found.append(("" if relative == "." else relative.replace(os.sep, "/"), Path(folder, ".gitignore").read_text(encoding="utf-8", errors="replace")))
    return found


def glob_match(name: str, pattern: str) -> bool:
    """Shell pattern on a name, as the tools use it."""
    return fnmatch.fnmatchcase(name, pattern)

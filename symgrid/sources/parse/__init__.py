"""Source files to definitions and references, as a table function over (path, content)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrid.functions.text import LANGUAGES, language_of
from symgrid.schemas import PARSED
from symgrid.sources.parse.common import Parsed
from symgrid.sources.parse.python import parse_python
from symgrid.sources.parse.script import parse_script

LIMIT = 1 << 23


def parse_source(data: bytes, language: str, path: str = "") -> Parsed | None:
    """Definitions and references of one file; None for a language that isn't supported.

    Broken syntax gives what can be told, with ``truncated``; invalid UTF-8 is replaced.
    """
    if language not in set(LANGUAGES.values()):
        return None
    text = data.decode("utf-8", "replace")
    return parse_python(path, text) if language == "python" else parse_script(path, text, language)


_ARROW = pa.schema(
    [
        ("path", pa.string()), ("language", pa.string()), ("loc", pa.int32()), ("truncated", pa.bool_()),
        ("defs", pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("doc", pa.string()), ("exported", pa.bool_())]))),
        ("refs", pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32())]))),
    ]
)


def parsed_files(files: DataFrame) -> DataFrame:
    """One row a supported file of (path, content): language, loc, truncated, defs, refs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    found = parse_source(content or b"", language, path)
                except Exception:  # one odd file must not end a scan of millions
                    found = Parsed(path, language, 0, True)
                if found is not None:
                    rows.append(found.row())
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    named = files.select("path", language_of("path").alias("language"), F.col("content").cast("binary").alias("content")).where("language is not null")
    return named.mapInArrow(run, PARSED)


def defs_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.inline("defs"))


def refs_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.inline("refs"))

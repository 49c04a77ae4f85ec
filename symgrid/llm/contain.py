"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles. In a partition of at most u shingles an
item's MinHash signature is its ``k = u - ceil(t u) + 1`` smallest shingle hashes: a text that
holds a share t or more of the item's shingles misses at most ``k - 1`` of them, so it holds at
least one of the signature. The search therefore loses no item, however long the text; a
signature of fixed length compared by Jaccard similarity would lose short items in long texts.
Candidates are verified by the exact words of every shingle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.llm.common import drop_dir, map_arrow, slices, table, work_dir

T = TypeVar("T")
WIDTH = 5
CONTAINMENT = 0.8
#: Items, and bytes of their texts, of one block: the only thing that goes to every executor.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
_WORD = re.compile(r"[^\W_]+")
_STEPS = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)]
_FILTER_BITS = 20


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall((text or "").lower())


def needed(n: int, containment: float) -> int:
    """Shingles of n that make up the share."""
    return max(1, math.ceil(containment * n - 1e-9))


def size_class(n: int) -> int:
    """Upper bound of the partition of items of n shingles: powers of the square root of two."""
    e = math.ceil(2 * math.log2(n) - 1e-9)
    return max(n, math.floor(2 ** (e / 2)))


class Index:
    """Signatures and shingles of a block of items, by the width of their shingles: ``width`` words, or all of a shorter item."""

    def __init__(self, items: Iterable[tuple[int | None, str | None]], width: int = WIDTH, containment: float = CONTAINMENT) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[int | None] = []
        by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in dict.fromkeys(items):
            words = words_of(text)
            if words:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
                by_width.setdefault(min(width, len(words)), []).append((len(self.items), ids))
                self.items.append(item)
        self.parts = [Part(w, own, containment) for w, own in sorted(by_width.items())]

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(row of ``texts``, item, shingles of it in the text, its shingles) for every contained item."""
        if not self.items:
            return []
        get = self.vocabulary.get
        cut = [np.fromiter(map(get, words, repeat(0)), np.int64, len(words)) for words in map(words_of, texts)]
        return [x for part in self.parts for x in part.search(cut)]


class Part:
    """The items of a block whose shingles have one width."""

    def __init__(self, width: int, items: list[tuple[int, np.ndarray]], containment: float) -> None:
        self.width, self.containment = width, containment
        self.numbers: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.shingles: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        for number, ids in items:
            hashes, first = np.unique(self.rolled(ids), return_index=True)
            upper = size_class(len(hashes))
            k = min(len(hashes), upper - needed(upper, containment) + 1)
            self.numbers.append(number)
            self.hashes.append(hashes)
            self.shingles.append(np.stack([ids[first + j] for j in range(width)], 1))
            marks.append(hashes[:k])
            owners.append(np.full(k, len(self.numbers) - 1))
        mark = np.concatenate(marks)
        order = np.argsort(mark, kind="stable")
        self.marks, self.owners = mark[order], np.concatenate(owners)[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.marks >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def rolled(self, ids: np.ndarray) -> np.ndarray:
        """Mixed 64-bit hash of every ``width`` consecutive word ids."""
        n = len(ids) - self.width + 1
        x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        out = np.zeros(max(0, n), np.uint64)
        for j in range(self.width if n > 0 else 0):
            out += x[j : j + n] * np.uint64(_STEPS[j])
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x94D049BB133111EB)
        return out ^ (out >> np.uint64(32))

    def search(self, cut: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """As :meth:`Index.search`, of the numbers of the words of texts, 0 for words of no item."""
        gap = self.width - 1
        starts = np.cumsum([0, *(len(w) + gap for w in cut)])
        ids = np.zeros(int(starts[-1]) + 1, np.int64)
        for words, at in zip(cut, starts.tolist()):
            ids[at : at + len(words)] = words
        hashes = self.rolled(ids)
        known = np.ones(len(hashes), bool)
        for j in range(self.width):
            known &= ids[j : j + len(hashes)] > 0
        near = np.flatnonzero(known & self.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        left, right = np.searchsorted(self.marks, hashes[near], "left"), np.searchsorted(self.marks, hashes[near], "right")
        rows = np.searchsorted(starts, near, side="right") - 1
        pairs = {(row, int(o)) for row, a, b in zip(rows.tolist(), left.tolist(), right.tolist()) if b > a for o in self.owners[a:b]}
        found: list[tuple[int, int, int, int]] = []
        held = (-1, hashes, ids)
        for row, owner in sorted(pairs):
            if held[0] != row:
                span = np.arange(starts[row], starts[row + 1] - 2 * gap)
                own, one = np.unique(hashes[span], return_index=True)
                held = (row, own, span[one])
            _, own, where = held
            at = np.minimum(np.searchsorted(own, self.hashes[owner]), len(own) - 1)
            same = own[at] == self.hashes[owner]
            for j in range(self.width):  # the words themselves, not only their hash
                same &= ids[where[at] + j] == self.shingles[owner][:, j]
            shared = int(same.sum())
            if shared >= needed(len(same), self.containment):
                found.append((row, self.numbers[owner], shared, len(same)))
        return found


def blocks(items: DataFrame, text: str, id: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of bounded size, read one partition at a time."""
    block, held = [], 0
    for row in items.select(F.col(id).cast("long"), F.col(text).cast("string")).toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or held + len(row[1] or "") > BLOCK_BYTES):
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += len(row[1] or "")
    yield block


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) for every text that holds ``containment`` of an item's word shingles.

    Words are lower-cased runs of letters and digits, shingles are distinct. An item of fewer than
    ``width`` words is one shingle of all of them; one without words matches nothing, nor do null
    texts. Repeated
    items count once, repeated documents each give their rows, null ids stay null, other columns
    are ignored and an empty table on either side gives an empty result. Documents don't move:
    each block of items, bounded in size, is sent to where they are, one pass over them a block.
    """
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())])
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found_in = work_dir(spark, "contained")
    ddl = "doc_id long, item_id long, n_shared long, n_item long"
    for number, block in enumerate(blocks(items, item_text, item_id)):
        shared = spark.sparkContext.broadcast(Index(block, width, containment))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for part in slices(batches):
                ids = part.column(0).to_pylist()
                found = [(ids[row], index.items[owner], n, of) for row, owner, n, of in index.search(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 4, schema.types)], schema=schema)

        map_arrow(rows, run, ddl).write.parquet(f"{found_in}/{number}")
        shared.destroy()
    return spark.read.schema(ddl).option("recursiveFileLookup", True).parquet(found_in)


def without_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that contain no item, as :func:`contained_items` tells; nothing moves.

    A block of items is a pass over what is left. All but the last one write it, so that one block
    at a time is on the executors.
    """
    spark, before = docs.sparkSession, None
    for block, last in marked_last(blocks(items, item_text, item_id)):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, width, containment))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text):
                found = {x[0] for x in shared.value.search(part.column(part.schema.get_field_index(text)).to_pylist())}
                yield part.filter(pa.array([k not in found for k in range(part.num_rows)], pa.bool_()))

        schema = docs.schema
        docs = map_arrow(docs, run, schema)
        if not last:
            path = work_dir(spark, "unleaked")
            docs.write.parquet(f"{path}/rows")
            shared.destroy()
            if before:
                drop_dir(spark, before)
            docs, before = spark.read.schema(schema).parquet(f"{path}/rows"), path
    return docs


def marked_last(things: Iterable[T]) -> Iterator[tuple[T, bool]]:
    """Each thing and whether it is the last one."""
    held: list[T] = []
    for thing in things:
        if held:
            yield held.pop(), False
        held.append(thing)
    if held:
        yield held.pop(), True


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair of at least 0.8 containment."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark),
ix AS (SELECT item_id, len(ws) AS n, least(5, len(ws)) AS k, ws, unnest(range(1, len(ws) + 1)) AS i FROM iw WHERE len(ws) > 0),
bs AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS s FROM ix WHERE i + k - 1 <= n),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
dx AS (SELECT doc_id, len(ws) AS n, ws, unnest(range(1, len(ws) + 1)) AS i FROM dw),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(ws[i:i + k - 1], ' ') AS s FROM dx, (SELECT DISTINCT k FROM bs) WHERE i + k - 1 <= n),
bn AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item FROM ds JOIN bs USING (k, s) JOIN bn USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 5 * count(*) >= 4 * n_item
"""

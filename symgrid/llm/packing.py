"""Best-fit packing of documents into fixed sequences by linear grouping.

The plan needs only how many pieces have each length, at most ``capacity`` numbers whatever the
corpus: large pieces are sorted and cut into groups of equal cardinality, every length of a
group is rounded up to its largest, configurations of these few sizes are optimised one after
another, and the actual pieces take the rounded places. Small pieces then go best-fit into
what is left. Sequences that hold the same lengths are one run of the plan, so the plan's size
doesn't grow with the corpus either. Pieces then find their place by their rank among the
pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgrid.llm.common import map_arrow, slices, stored, table
from symgrid.llm.tokens import VOCABULARY, encoder

CAPACITY = 4096
#: Pieces above this share of the capacity are large.
LARGE = 0.25
GROUPS = 256
#: (share, groups) of the plans that are made until one has as few sequences as any can; each groups the large pieces.
TRIED = ((LARGE, GROUPS), (0.375, 256), (LARGE, 1024), (0.5, 256), (0.375, 1024))
#: Pieces of one length that one task ranks, about.
RANKED = 1 << 18


class Plan:
    """Runs of sequences and the places of each length in them.

    A place is (length, first rank, number of sequences, pieces a sequence, first sequence, offset).
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.sequences = 0
        self.places: list[tuple[int, int, int, int, int, int]] = []
        self.used: dict[int, int] = defaultdict(int)
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def open(self, n: int) -> int:
        """The first of ``n`` new sequences."""
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, first: int, n: int, each: int, offset: int) -> None:
        """``each`` pieces of ``length`` into each of ``n`` sequences from ``first`` on, at ``offset``."""
        self.places.append((length, self.used[length], n, each, first, offset))
        self.used[length] += n * each

    def leave(self, free: int, first: int, n: int) -> None:
        """Note that ``n`` sequences from ``first`` on have ``free`` tokens left."""
        if free and n:
            if free not in self.room or not self.room[free]:
                bisect.insort(self.rooms, free)
            self.room[free].append((first, n))

    def best_fit(self, length: int, count: int) -> None:
        """Put ``count`` pieces where least is left over, in new sequences if nowhere fits."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                n = max(1, count // each)
                each = min(each, count)
                self._fill(length, self.open(n), n, each, self.capacity)
                count -= n * each
                continue
            free = self.rooms[at]
            first, n = self.room[free].pop()
            if not self.room[free]:
                del self.rooms[at]
            each = free // length
            whole = min(n, count // each)
            self._fill(length, first, whole, each, free)
            count -= whole * each
            rest = n - whole
            if rest and count:
                self._fill(length, first + whole, 1, count, free)
                rest, count, whole = rest - 1, 0, whole + 1
            self.leave(free, first + whole, rest)

    def _fill(self, length: int, first: int, n: int, each: int, free: int) -> None:
        if n and each:
            self.put(length, first, n, each, self.capacity - free)
            self.leave(free - each * length, first, n)


def _groups(counts: dict[int, int], k: int) -> list[list[list[int]]]:
    """Lengths in descending order in ``k`` groups of equal cardinality, as [length, count] lists."""
    total = sum(counts.values())
    groups: list[list[list[int]]] = []
    seen = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if len(groups) * total <= seen * k and len(groups) < k:
                groups.append([])
            edge = total if len(groups) == k else -(-len(groups) * total // k)
            take = max(1, min(left, edge - seen))
            groups[-1].append([length, take])
            seen += take
            left -= take
    return groups


def _fullest(sizes: list[int], left: list[int], first: int, capacity: int) -> dict[int, int]:
    """The fullest configuration that holds group ``first``; group: how often."""
    room = capacity - sizes[first]
    chosen = {first: 1}
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    steps: list[tuple[int, np.ndarray]] = []
    for g in range(first, len(sizes)):
        most = min(left[g] - (g == first), room // sizes[g])
        for _ in range(most):
            new = reach.copy()
            new[sizes[g] :] |= reach[: room + 1 - sizes[g]]
            if np.array_equal(new, reach):
                break
            steps.append((g, reach))
            reach = new
        if reach[room]:
            break
    at = int(np.flatnonzero(reach)[-1])
    for g, before in reversed(steps):
        if at and not before[at]:
            chosen[g] = chosen.get(g, 0) + 1
            at -= sizes[g]
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> Plan:
    """Places for ``counts[length]`` pieces of each length from 1 to ``capacity``."""
    out = Plan(capacity)
    if counts.get(capacity):
        out.put(capacity, out.open(counts[capacity]), counts[capacity], 1, 0)
    cut = int(capacity * large)
    runs = _groups({k: v for k, v in counts.items() if cut < k < capacity and v}, groups)
    sizes = [g[0][0] for g in runs]
    left = [sum(n for _, n in g) for g in runs]
    for first in range(len(sizes)):
        while left[first]:
            chosen = _fullest(sizes, left, first, capacity)
            n = min(left[g] // k for g, k in chosen.items())
            slots = [g for g, k in sorted(chosen.items()) for _ in range(k)]
            start = out.open(n)
            taken = []
            for g in slots:  # the next n actual pieces of the group, as runs of one length
                need, own = n, []
                while need:
                    length, have = runs[g][0]
                    take = min(need, have)
                    own.append((length, take))
                    runs[g][0][1] -= take
                    if have == take:
                        runs[g].pop(0)
                    need -= take
                left[g] -= n
                taken.append(own)
            edges = sorted({e for own in taken for e in np.cumsum([t for _, t in own]).tolist()})
            at, heads = 0, [0] * len(slots)
            ends = [np.cumsum([t for _, t in own]).tolist() for own in taken]
            for edge in edges:
                offset = 0
                for s, own in enumerate(taken):
                    out.put(own[heads[s]][0], start + at, edge - at, 1, offset)
                    offset += own[heads[s]][0]
                    if ends[s][heads[s]] == edge:
                        heads[s] += 1
                out.leave(capacity - offset, start + at, edge - at)
                at = edge
    for length in range(min(cut, capacity - 1), 0, -1):
        if counts.get(length):
            out.best_fit(length, counts[length])
    return out


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with fewest sequences among those of :data:`TRIED`; none after one that fills all sequences but the last."""
    best: Plan | None = None
    least = -(-sum(k * n for k, n in counts.items()) // capacity)
    for large, groups in TRIED:
        one = plan(counts, capacity, large, groups)
        if best is None or one.sequences < best.sequences:
            best = one
        if best.sequences == least:
            break
    assert best is not None
    return best


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document cut at ``capacity`` tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for part in slices(batches):
            rows = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, piece, start, len(own) // 4, zlib.crc32(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document in a sequence.

    Null texts are empty documents (the end id alone); repeated rows are documents of their own;
    null doc_ids keep their null; other columns are ignored; an empty table gives an empty
    result. The driver gets one count for each length, at most ``capacity`` rows. Pieces are
    ranked within (length, salt), a length of many pieces having a salt for every
    :data:`RANKED` of them, so that no task ranks a third of all pieces.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, capacity, vocabulary, text, id), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    # At most ``capacity`` rows; equal pieces are interchangeable, so it doesn't matter in which order they are ranked.
    salts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in counts.items()], "length long, salts long")
    cut = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")))
    parts = cut.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    firsts = parts.select("length", "salt", F.coalesce(before, F.lit(0)).cast("long").alias("first"))
    places = np.array(best_plan(counts, capacity).places or np.zeros((0, 6)), np.int64)
    key = places[:, 0] << 40 | places[:, 1]
    order = np.argsort(key, kind="stable")
    shared = spark.sparkContext.broadcast((key[order], places[order]))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = rows[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            k = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(at[:, 4] + k // at[:, 3]), pa.array(at[:, 5] + k % at[:, 3] * length)], schema=schema)

    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    numbered = cut.withColumn("n", within).drop("salts")
    ranked = numbered.join(firsts, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("n") - 1).cast("long").alias("rank"))
    return map_arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return pack(table(spark, sf_dir, "documents"))

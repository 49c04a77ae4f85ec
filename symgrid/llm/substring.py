"""Removal of repeated word windows by FM-indexes over shards, with documents streamed through them.

A window that occurs twice is found by its matching statistics: backward search over a wavelet
matrix tells, for every place of a stream, how far the index agrees with it and the interval of
suffixes that do. Where that is a whole window, the suffixes of the interval are all places
where it occurs, and every one but the earliest is a repeat. Nothing else declares a repeat.

An index of the whole corpus that all of it is streamed through costs the square of the corpus,
so there are two rounds of shards, and a filter before them:

1. Filter. The smallest hash of the 8-word grams of a window is its anchor; equal windows have
   equal anchors, so a window whose anchor occurs nowhere else is no repeat. Documents are kept
   in buckets of bounded size, and each bucket reports its distinct anchors with how often they
   occur. Anchors that occur once in all are left out from here on.
2. First round: a bucket of documents is a shard. What of its distinct texts has anchors that
   occur again is indexed and streamed through the index. Equal texts share one stream; windows
   of a text that stands there again are repeats in all its later rows.
3. Second round: shards by content. The first of equal windows of each bucket, if its anchor
   occurs in other buckets, goes to the shard of the anchor: consecutive windows of one anchor as
   one stretch of words, with a dictionary of the words a bucket and shard. A passage that a
   third of all documents hold comes once a bucket. Anchors of more than :data:`HOT` occurrences
   don't meet in one shard: their windows travel alone, each to the shard of its own hash.
4. Buckets cover the words of their repeats.

Words are numbered by their bytes, in a bucket and again in a shard; hashes only say where a
window travels. Texts are written once, as compressed numbers of words, and never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.llm.common import filesystem, map_arrow, open_file, put, slices, stored, table, work_dir
from symgrid.llm.fmindex import FMIndex

WINDOW = 20
GRAM = 8
#: Text bytes of a bucket of documents (a longer document is a bucket of its own).
BUCKET_BYTES = 8 << 20
#: Occurrences of an anchor above which its windows travel alone: some 30 MB of stretches in one shard.
HOT = 1 << 18
#: Windows of one stream; a longer stretch is several, which overlap by a window.
STREAM = 128
_STEPS = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)]
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_ANCHORS = "part int, src string, seen binary, times binary"
_ELSEWHERE, _HOT = 1, 2


class Words(dict[bytes, int]):
    """Numbers of words from 1 on, in the order in which they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def mixed(words: Iterable[bytes], n: int) -> np.ndarray:
    """A 64-bit hash of each of ``n`` words, with a place 0 for no word."""
    x = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate([np.zeros(1, np.uint64), x ^ (x >> np.uint64(29))])


def _finished(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += hashes[j : j + n] * np.uint64(_STEPS[j % 64])
    return _finished(out)


def slid(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` consecutive numbers."""
    k = 1
    while 2 * k <= width:
        x = best(x[:-k], x[k:])
        k *= 2
    rest = width - k
    return best(x[:-rest], x[rest:]) if rest else x


def parted(values: np.ndarray, parts: int) -> np.ndarray:
    """The part that each value belongs to."""
    return ((values * _SPREAD) >> np.uint64(33)).astype(np.int64) % parts


def by_part(part: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, indices of its members) of every part that has any."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    return [(int(k), order[edges[k] : edges[k + 1]]) for k in np.flatnonzero(np.diff(edges))]


def spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of slices, one slice after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def runs_of(*following: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of runs in which the last array grows by one and the others stay the same."""
    n = len(following[-1])
    new = np.ones(n, bool)
    if n:
        new[1:] = following[-1][1:] != following[-1][:-1] + 1
        for x in following[:-1]:
            new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    if most is not None and n:
        within = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        first = np.flatnonzero(within % most == 0)
    return first, np.diff(np.append(first, n))


class Texts:
    """A bucket: words of its distinct texts as numbers, one text after the other, and its rows.

    ``rows`` are (doc_id, number of the text) in the order that repeats follow: by doc_id, nulls
    last, then text. Texts are numbered in the order of their first rows.
    """

    def __init__(self, rows: list[tuple[int | None, int]], words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.rows, self.words, self.ids, self.lengths = rows, words, ids, lengths
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    @classmethod
    def of(cls, rows: list[tuple[int | None, bytes]]) -> Texts:
        """The bucket of (doc_id, text)."""
        numbers, same = Words(), Words()
        own = [(i, same[t] - 1) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
        get, parts = numbers.__getitem__, [np.zeros(0, np.int32)]
        for text in same:
            words = text.split()
            parts.append(np.fromiter(map(get, words), np.int32, len(words)))
        return cls(own, list(numbers), np.concatenate(parts), np.array([len(p) for p in parts[1:]], np.int64))

    @classmethod
    def read(cls, path: str) -> Texts:
        with open_file(path) as source:
            doc_id, known, text, words, ids, lengths = (source_column[0].as_py() for source_column in pa.ipc.open_file(source).read_all().columns)
        doc_ids = [i if k else None for i, k in zip(np.frombuffer(doc_id, np.int64).tolist(), np.frombuffer(known, bool).tolist())]
        return cls(list(zip(doc_ids, np.frombuffer(text, np.int32).tolist())), words.split(b" ") if words else [], np.frombuffer(ids, np.int32), np.frombuffer(lengths, np.int64))

    def write(self, path: str) -> None:
        ids, texts = zip(*self.rows)
        columns = (np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], bool), np.array(texts, np.int32), b" ".join(self.words), self.ids, self.lengths)
        batch = pa.RecordBatch.from_arrays([pa.array([c if type(c) is bytes else c.tobytes()], pa.large_binary()) for c in columns], names=["doc_id", "known", "text", "words", "ids", "lengths"])
        out = pa.BufferOutputStream()
        with pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        put(path, [out.getvalue()])

    def anchor(self, window: int, gram: int) -> None:
        """Find the anchor of every window; those that reach from one text into the next aren't valid."""
        self.window, self.span = window, window - gram + 1
        self.hashes = mixed(self.words, len(self.words))[self.ids]
        self.grams = rolled(self.hashes, gram)
        self.anchors = slid(self.grams, self.span, np.minimum) if len(self.ids) >= window else np.zeros(0, np.uint64)
        self.valid = np.repeat(self.ends, self.lengths)[: len(self.anchors)] - np.arange(len(self.anchors)) >= window

    def anchored(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, and how many places of all rows they stand at."""
        if not len(self.anchors):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        none = np.zeros(self.span - 1, np.uint64)
        chosen = np.flatnonzero(slid(np.concatenate([none, np.where(self.valid, self.anchors, np.uint64(0)), none]), self.span, np.maximum) == self.grams)
        values, number = np.unique(self.grams[chosen], return_inverse=True)
        times = np.bincount([t for _, t in self.rows])[np.searchsorted(self.ends, chosen, side="right")]
        return values, np.bincount(number, times, len(values)).astype(np.int64)

    def window_hashes(self, places: np.ndarray) -> np.ndarray:
        """Hash of the whole windows that begin at ``places``."""
        out = np.zeros(len(places), np.uint64)
        for j in range(self.window):
            out += self.hashes[places + j] * np.uint64(_STEPS[j % 64])
        return _finished(out)


def intervals(symbols: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """For every window of every stretch the number of its interval in an index of all stretches; -1 where none is as long.

    ``symbols`` are those of all stretches, from 1 on, one stretch after the other. Equal numbers
    mean equal windows.
    """
    used = np.zeros(int(symbols.max(initial=0)) + 1, bool)
    used[symbols] = True
    begins = np.cumsum(lengths) - lengths
    text = np.insert(np.cumsum(used)[symbols], begins[1:], 0)  # a zero between stretches
    begins = begins + np.arange(len(lengths))
    index = FMIndex(text, window)
    match, low, _ = index.matching_statistics(text, begins, lengths)
    at = spread(begins, lengths - window + 1)
    return np.where(match[at] >= window, index.run_of[low[at]], -1)


def firsts(run: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Whether each window is the earliest of its interval; ``order``: sort keys, the most important one last, none if sorted."""
    sort = np.lexsort((*order, run)) if order else np.argsort(run, kind="stable")
    out = np.zeros(len(run), bool)
    out[sort] = np.concatenate([[True], run[sort][1:] != run[sort][:-1]])[: len(run)]
    return out


def put_spans(path: str, *columns: np.ndarray) -> None:
    """Keep (row, first window, number of windows) of repeats beside their bucket."""
    put(path, [np.stack(columns).astype(np.int32).tobytes()])


def spans_at(path: str) -> np.ndarray:
    """What :func:`put_spans` kept, three rows of numbers; none if there is no such file."""
    fs, plain = filesystem(path)
    if not fs.get_file_info(plain).is_file:
        return np.zeros((3, 0), np.int32)
    with open_file(path) as source:
        return np.frombuffer(source.read(), np.int32).reshape(3, -1)


def scan_bucket(folder: str, rows: list[tuple[int | None, bytes]], parts: int, window: int, gram: int) -> pa.RecordBatch:
    """Keep a bucket and report its anchors by part."""
    src = uuid.uuid4().hex
    texts = Texts.of(rows)
    texts.write(f"{folder}/{src}")
    texts.anchor(window, gram)
    values, times = texts.anchored()
    cuts = by_part(parted(values, parts), parts) or [(0, np.zeros(0, np.int64))]
    few = np.minimum(times, 65535).astype(np.uint16)
    types = [pa.int32(), pa.string(), pa.binary(), pa.binary()]
    columns = ([k for k, _ in cuts], [src] * len(cuts), [values[c].tobytes() for _, c in cuts], [few[c].tobytes() for _, c in cuts])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _ANCHORS.split(", ")])


def scan(docs: DataFrame, folder: str, parts: int, window: int, gram: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the buckets and report their anchors; every attempt of a task writes files of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int | None, bytes]] = []
        held = 0
        for batch in slices(batches, "text", 1 << 20):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                text = text or b""
                if rows and held + len(text) > bucket_bytes:
                    yield scan_bucket(folder, rows, parts, window, gram)
                    rows, held = [], 0
                rows.append((doc_id, text))
                held += len(text) + 64
        if rows:
            yield scan_bucket(folder, rows, parts, window, gram)

    return map_arrow(docs, run, _ANCHORS)


def repeated_anchors(group: pa.Table, hot: int = HOT) -> pa.Table:
    """For each bucket of a part the anchors that occur more than once, and whether elsewhere and very often."""
    srcs = group.column("src").to_pylist()
    seen = [np.frombuffer(b, np.uint64) for b in group.column("seen").to_pylist()]
    times = np.frombuffer(b"".join(group.column("times").to_pylist()), np.uint16)
    owner = np.repeat(np.arange(len(srcs)), [len(x) for x in seen])
    values = np.concatenate(seen)
    number = np.unique(values, return_inverse=True)[1]
    buckets = np.bincount(number)[number] if len(number) else number
    total = np.bincount(number, times)[number] if len(number) else number
    marks = _ELSEWHERE * (buckets > 1) + _HOT * (total > hot)
    keep = total > 1
    values, owner, marks = values[keep], owner[keep], marks[keep].astype(np.uint8)
    edges = np.searchsorted(owner, np.arange(len(srcs) + 1))
    rows = [(s, values[a:b].tobytes(), marks[a:b].tobytes()) for s, a, b in zip(srcs, edges, edges[1:]) if b > a]
    return pa.table({c: pa.array([r[k] for r in rows], pa.string() if k == 0 else pa.binary()) for k, c in enumerate(("src", "anchors", "marks"))})


_STRETCH = "part int, src string, doc_id binary, known binary, row binary, start binary, n binary, words binary, ids binary"


def bucket_repeats(group: pa.Table, folder: str, parts: int, window: int, gram: int) -> pa.Table:
    """First round: keep the repeats within a bucket beside it; stretches of the first windows that others may hold."""
    src = group.column("src")[0].as_py()
    anchors = np.frombuffer(b"".join(group.column("anchors").to_pylist()), np.uint64)
    order = np.argsort(anchors)
    anchors, marks = anchors[order], np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8)[order]
    texts = Texts.read(f"{folder}/{src}")
    texts.anchor(window, gram)
    rows_of: list[list[int]] = [[] for _ in texts.lengths]
    for row, (_, text_of) in enumerate(texts.rows):
        rows_of[text_of].append(row)
    at = np.minimum(np.searchsorted(anchors, texts.anchors), len(anchors) - 1)
    place = np.flatnonzero(texts.valid & (anchors[at] == texts.anchors))
    first, n = runs_of(place, most=STREAM)
    run = intervals(texts.ids[spread(place[first], n + window - 1)], n + window - 1, window)
    text = np.searchsorted(texts.ends, place, side="right")
    start = place - texts.starts[text]
    own = np.array([r[0] for r in rows_of], np.int64)[text]
    # Texts stand in the order of their first rows, so places are in the order that repeats follow.
    early = firsts(run)
    gone = np.flatnonzero(~early & (run >= 0))
    spans = [(own[gone][k], start[gone][k], n) for k, n in [runs_of(own[gone], start[gone])]]
    held = np.flatnonzero(run >= 0)
    copies = []
    k, n = runs_of(text[held], start[held])
    of, begin = text[held][k], start[held][k]
    for t, first_span, last_span in zip(*_groups(of)):
        for row in rows_of[t][1:]:
            copies.append((np.full(last_span - first_span, row), begin[first_span:last_span], n[first_span:last_span]))
    put_spans(f"{folder}/{src}.repeats", *(np.concatenate(c) for c in zip(*spans, *copies)))
    sent = np.flatnonzero(early & (run >= 0) & (marks[at[place]] & _ELSEWHERE > 0))
    hot = marks[at[place[sent]]] & _HOT > 0
    key = texts.anchors[place[sent]]
    # A window that travels alone has a key of its own.
    key[hot] = texts.window_hashes(place[sent][hot])
    first, n = runs_of(key, np.where(hot, -2 * np.arange(len(sent)), 0), place[sent], most=STREAM)
    row, start, part = own[sent][first], start[sent][first], parted(key[first], parts)
    begins = place[sent][first]
    out: list[tuple] = []
    for k, cut in by_part(part, parts):
        ids = texts.ids[spread(begins[cut], n[cut] + window - 1)]
        number, local = np.unique(ids, return_inverse=True)
        doc_ids = [texts.rows[i][0] for i in row[cut].tolist()]
        words = b" ".join(texts.words[i - 1] for i in number.tolist())
        out.append((k, src, np.array([i or 0 for i in doc_ids], np.int64).tobytes(), np.array([i is not None for i in doc_ids], bool).tobytes(), row[cut].astype(np.int32).tobytes(), start[cut].astype(np.int32).tobytes(), n[cut].astype(np.int32).tobytes(), words, local.astype(np.uint16 if len(number) < 1 << 16 else np.int32).tobytes()))
    columns = list(zip(*out)) or [()] * 9
    types = [pa.int32(), pa.string(), *[pa.binary()] * 7]
    return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(_STRETCH.split(", "), columns, types)})


def _groups(sorted_values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(value, first, end) of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])[: len(sorted_values)])
    return sorted_values[first].tolist(), first.tolist(), np.append(first[1:], len(sorted_values)).tolist()


def shard_repeats(group: pa.Table, window: int) -> pa.Table:
    """Second round: for each bucket the windows of its stretches that occur earlier in another stretch of the shard."""
    srcs = group.column("src").to_pylist()
    joined = lambda name, kind: np.concatenate([np.frombuffer(b, kind) for b in group.column(name).to_pylist()])
    src = np.repeat(np.arange(len(srcs)), [len(b) // 4 for b in group.column("row").to_pylist()])
    rank = np.argsort(np.argsort(np.array(srcs)))  # ties between equal doc_ids follow the bucket's name
    row, start, n = (joined(c, np.int32).astype(np.int64) for c in ("row", "start", "n"))
    doc_id, known = joined("doc_id", np.int64), joined("known", bool)
    get = Words().__getitem__
    parts = []
    for words, ids in zip(group.column("words").to_pylist(), group.column("ids").to_pylist()):
        numbers = np.array([*map(get, words.split(b" "))], np.int64)
        parts.append(numbers[np.frombuffer(ids, np.uint16 if len(numbers) < 1 << 16 else np.int32)])
    run = intervals(np.concatenate(parts), n + window - 1, window)
    of = np.repeat(np.arange(len(n)), n)
    place = start[of] + spread(np.zeros(len(n), np.int64), n)
    early = firsts(run, place, row[of], rank[src[of]], doc_id[of], ~known[of])
    gone = np.flatnonzero(~early & (run >= 0))
    gone = gone[np.lexsort((place[gone], row[of[gone]], src[of[gone]]))]
    k, count = runs_of(src[of[gone]], row[of[gone]], place[gone])
    owner, first, begin = src[of[gone]][k], row[of[gone]][k], place[gone][k]
    edges = np.searchsorted(owner, np.arange(len(srcs) + 1))
    out = [(s, np.stack([first[a:b], begin[a:b], count[a:b]]).astype(np.int32).tobytes()) for s, a, b in zip(srcs, edges, edges[1:]) if b > a]
    return pa.table({"src": pa.array([r[0] for r in out], pa.string()), "spans": pa.array([r[1] for r in out], pa.binary())})


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.string())])


def covered(path: str, told: list[bytes], window: int) -> Iterator[pa.RecordBatch]:
    """The rows of a bucket without the words that its repeats cover."""
    row, start, count = np.concatenate([spans_at(path + ".repeats"), *(np.frombuffer(b, np.int32).reshape(3, -1) for b in told)], axis=1)
    order = np.argsort(row, kind="stable")
    row, start, end = row[order], start[order], start[order] + count[order] + window - 1
    texts = Texts.read(path)
    edges = np.searchsorted(row, np.arange(len(texts.rows) + 1)).tolist()
    get, starts = [b"", *texts.words].__getitem__, texts.starts.tolist()
    out: list[tuple] = []
    held = 0
    for k, (doc_id, text) in enumerate(texts.rows):
        n = int(texts.lengths[text])
        ids = texts.ids[starts[text] : starts[text] + n]
        a, b = edges[k], edges[k + 1]
        spans: list[dict[str, int]] = []
        if b > a:
            merged: list[list[int]] = []
            for x, y in sorted(zip(start[a:b].tolist(), end[a:b].tolist())):
                if merged and x <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], y)
                else:
                    merged.append([x, y])
            spans = [{"start": x, "end": y} for x, y in merged]
            ids = np.concatenate([ids[x:y] for (_, x), (y, _) in zip([[0, 0], *merged], [*merged, [n, n]])])
        out.append((doc_id, n, n - len(ids), spans, b" ".join(map(get, ids.tolist())).decode()))
        held += len(out[-1][4]) + 64
        if held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _RESULT.types)], schema=_RESULT)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _RESULT.types)], schema=_RESULT)


def without_repeats(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) of every row of ``docs``.

    A window is ``window`` consecutive words (runs of anything but the six ASCII white-space
    characters). Every word covered by a window that also starts earlier, in a smaller doc_id or
    earlier in the same document, is removed; windows are judged on the input. ``removed`` lists
    the word spans, ``kept`` joins the other words by one space. Null texts have no words. Rows
    of one doc_id are ordered among themselves in some fixed way, so of repeated rows one stays
    whole; null doc_ids come last. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    gram = max(1, min(GRAM, window // 2))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, int(total // bucket_bytes))
    wide = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = work_dir(spark, "buckets")
    anchors = stored(scan(rows, folder, parts, window, gram, bucket_bytes), "anchors")
    told = anchors.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: repeated_anchors(t, hot), "src string, anchors binary, marks binary")
    moved = told.repartition(wide, "src").groupBy("src").applyInArrow(lambda t: bucket_repeats(t, folder, parts, window, gram), _STRETCH)
    shards = moved.repartition(wide, "part").groupBy("part").applyInArrow(lambda t: shard_repeats(t, window), "src string, spans binary")
    none = anchors.select("src", F.lit(None).cast("binary").alias("spans")).distinct()

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, spans in zip(*(c.to_pylist() for c in batch.columns)):
                yield from covered(f"{folder}/{src}", spans, window)

    # A bucket gets at most one list a part, about its own texts.
    replies = stored(shards, "repeats").unionByName(none).repartition(wide, "src").groupBy("src").agg(F.collect_list("spans").alias("spans"))
    return map_arrow(replies, finish, "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document and what is left of them."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT *, CASE WHEN i + 19 <= n THEN string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS s FROM x),
r AS (SELECT doc_id, w, i, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM g),
c AS (SELECT *, max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM r),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

"""Byte-level convolutional quality classifier in numpy.

Bytes have learned embeddings; learned filters of :data:`WIDTH` bytes run over every position
of a text. Their rectified outputs are max-pooled over overlapping chunks of two hops that
cover the whole text, a small layer rates each chunk, and mean and maximum over all chunks are
combined into one probability. Filters and embeddings multiply out to one row of a table for
each (offset, byte), so a convolution is a few table look-ups. A text's score is made of sums in
an order of its own, never of products of whole batches: it is the same bit for bit whatever
texts are scored with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgrid.llm.common import map_arrow, slices, table

WIDTH, FILTERS, EMBEDDED, HIDDEN, HOP = 8, 16, 8, 16, 256
ROW = HOP + WIDTH - 1
#: Labelled rows a model is fitted on, at most: those with the smallest hash of their doc_id.
SAMPLE = 3000
#: UTF-8 bytes of one text, and of all texts, that a model is fitted on, at most; longer ones are scored like any other.
TEXT_BYTES, SAMPLE_BYTES = 1 << 20, 64 << 20
EPOCHS, BATCH, RATE = 14, 32, 0.012
#: Batches a model sees at least: small samples go round more often.
STEPS = 400
THRESHOLD = 0.3
_BLOCK = 128


def product(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``rows @ weights`` in double precision, summed over the columns from left to right in every row."""
    out = np.zeros((len(rows), *weights.shape[1:]))
    for k, w in enumerate(weights.astype(float)):
        out += rows[:, k].astype(float).reshape(-1, *[1] * w.ndim) * w
    return out


class Model:
    """Parameters, scores and training."""

    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        normal = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {
            "embed": normal(256, EMBEDDED, s=0.5),
            "filter": normal(WIDTH, EMBEDDED, FILTERS, s=0.35),
            "bias": np.zeros(FILTERS, np.float32),
            "chunk": normal(FILTERS, HIDDEN, s=0.3),
            "chunk_bias": np.zeros(HIDDEN, np.float32),
            "mean": normal(HIDDEN, s=0.1),
            "max": normal(HIDDEN, s=0.1),
            "out": np.zeros(1, np.float32),
        }

    def tables(self) -> np.ndarray:
        """Contribution of each byte at each offset of a filter, (offset, byte, filter)."""
        return np.matmul(self.p["embed"], self.p["filter"]).astype(np.float32)

    @staticmethod
    def laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hops of all texts, a row each, with the bytes a filter reads past a hop's end; first hop of each text.

        What follows a text is zeros, never the next text: a score doesn't depend on its neighbours.
        """
        hops = np.array([max(1, -(-len(t) // HOP)) for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(hops)])
        data = np.zeros((int(first[-1]), ROW), np.uint8)
        for text, at, n in zip(texts, first[:-1].tolist(), hops.tolist()):
            flat = np.zeros(n * HOP + WIDTH - 1, np.uint8)
            flat[: len(text)] = np.frombuffer(text, np.uint8)
            data[at : at + n] = np.lib.stride_tricks.sliding_window_view(flat, ROW)[::HOP]
        return data, first

    def pooled(self, data: np.ndarray, tables: np.ndarray, where: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Maximum of each filter in each hop before the bias and the rectifier, and at which byte of all rows."""
        hops = len(data)
        top = np.empty((hops, FILTERS), np.float32)
        at = np.empty((hops, FILTERS), np.int64) if where else None
        total = np.empty((min(_BLOCK, hops) * HOP, FILTERS), np.float32)
        part = np.empty_like(total)
        for a in range(0, hops, _BLOCK):
            rows = data[a : a + _BLOCK]
            n = len(rows) * HOP
            np.take(tables[0], rows[:, :HOP].ravel(), axis=0, out=total[:n], mode="clip")
            for k in range(1, WIDTH):
                np.take(tables[k], rows[:, k : k + HOP].ravel(), axis=0, out=part[:n], mode="clip")
                total[:n] += part[:n]
            cube = total[:n].reshape(-1, HOP, FILTERS)
            if at is None:
                while cube.shape[1] > 1:  # halves, since a reduction along a middle axis is slow
                    half = cube.shape[1] // 2
                    cube = np.maximum(cube[:, :half], cube[:, half:])
                top[a : a + len(cube)] = cube[:, 0]
            else:
                own = cube.argmax(1)
                top[a : a + len(cube)] = np.take_along_axis(cube, own[:, None], 1)[:, 0]
                at[a : a + len(cube)] = own + (a + np.arange(len(cube)))[:, None] * ROW
        return top, at

    def forward(self, first: np.ndarray, top: np.ndarray) -> dict[str, np.ndarray]:
        """From hop maxima to one logit a text; keeps what the way back needs."""
        p = self.p
        hop = np.maximum(top + p["bias"], 0)
        # A chunk is a hop and the next one of the same text.
        nxt = np.minimum(np.arange(len(top)) + 1, np.repeat(first[1:] - 1, np.diff(first)))
        later = hop[nxt] > hop
        chunk = np.where(later, hop[nxt], hop)
        inner = product(chunk, p["chunk"]) + p["chunk_bias"]
        rated = np.maximum(inner, 0)
        mean = np.add.reduceat(rated, first[:-1]) / np.diff(first)[:, None]
        most = np.maximum.reduceat(rated, first[:-1])
        logit = product(mean, p["mean"]) + product(most, p["max"]) + p["out"]
        return {"hop": hop, "next": nxt, "later": later, "chunk": chunk, "inner": inner, "rated": rated, "mean": mean, "most": most, "logit": logit}

    def scores(self, texts: list[bytes], tables: np.ndarray | None = None) -> np.ndarray:
        """Probability of label 1 for each text."""
        data, first = self.laid(texts)
        top, _ = self.pooled(data, self.tables() if tables is None else tables, False)
        return np.array([1 / (1 + math.exp(-min(700.0, max(-700.0, x)))) for x in self.forward(first, top)["logit"].tolist()])

    def step(self, data: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of a batch of texts as :meth:`laid` out."""
        p = self.p
        tables = self.tables()
        top, at = self.pooled(data, tables, True)
        f = self.forward(first, top)
        y = 1 / (1 + np.exp(-f["logit"]))
        loss = float(-np.mean(np.where(labels > 0, np.log(y + 1e-9), np.log(1 - y + 1e-9))))
        d = ((y - labels) / len(labels)).astype(np.float32)
        g = {"out": d.sum(keepdims=True), "mean": f["mean"].T @ d, "max": f["most"].T @ d}
        sizes = np.diff(first)
        rated = np.repeat(d / sizes, sizes)[:, None] * p["mean"]
        owner = np.repeat(np.arange(len(labels)), sizes)
        is_most = f["rated"] == f["most"][owner]
        rated += is_most * (d[owner, None] * p["max"]) / np.maximum(1, np.add.reduceat(is_most, first[:-1], dtype=np.float32))[owner]
        inner = rated * (f["inner"] > 0)
        g |= {"chunk": f["chunk"].T @ inner, "chunk_bias": inner.sum(0)}
        chunk = inner @ p["chunk"].T
        hop = np.where(f["later"], 0, chunk)
        hop[1:] += np.where(f["later"], chunk, 0)[:-1]  # a later hop is the next row
        hop *= f["hop"] > 0
        g["bias"] = hop.sum(0)
        filters, flat, weights = np.arange(FILTERS), data.ravel(), hop.ravel()
        table = np.stack([np.bincount((flat[at + k].astype(np.int64) * FILTERS + filters).ravel(), weights, 256 * FILTERS).reshape(256, FILTERS) for k in range(WIDTH)])
        g["embed"] = np.matmul(table, p["filter"].transpose(0, 2, 1)).sum(0)
        g["filter"] = np.matmul(p["embed"].T, table)
        return loss, g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 5) -> Model:
        """Adam over batches in random orders fixed by the seed."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        t, order = 0, np.arange(len(texts))
        data, first = self.laid(texts)
        batches = -(-len(texts) // batch)
        epochs = max(epochs, -(-STEPS // batches))
        total = epochs * batches
        for _ in range(epochs):
            r.shuffle(order)
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                sizes = first[rows + 1] - first[rows]
                own = np.concatenate([[0], np.cumsum(sizes)])
                _, g = self.step(data[np.repeat(first[rows] - own[:-1], sizes) + np.arange(own[-1])], own, labels[rows])
                t += 1
                now = rate * min(1.0, t / 50) * (1 - 0.9 * t / total)
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        return self


def held_out() -> Column:
    """Whether a row's label is never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", id: str = "doc_id", label: str = "quality") -> Model | None:
    """A model fitted on at most ``sample`` labelled rows that aren't held out; None if there are none.

    Rows are those with the smallest hash of their doc_id, so they don't depend on how tables
    are partitioned; texts above :data:`TEXT_BYTES` aren't among them, and the first
    :data:`SAMPLE_BYTES` of texts are taken. A row without text or label isn't learned from; of
    repeated rows each counts.
    """
    marked = labels.select(F.col(id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out())
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") <= TEXT_BYTES)
    # The bounds apply before the texts move: only chosen ids, with the bytes of their texts, come first.
    sizes = rows.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes"))
    chosen = marked.join(sizes, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample).collect()
    total = np.cumsum([r["bytes"] for r in chosen])
    few = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r, t in zip(chosen, total) if t <= SAMPLE_BYTES], "doc_id long, y int")
    got = rows.join(F.broadcast(few), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()
    if not got:
        return None
    return Model().fit([r.text.encode() for r in got], np.array([r.y > 0 for r in got], np.float32))


def scored(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """Every column of ``docs`` and ``name``, the probability of label 1 of the whole text.

    Null and empty texts are one chunk of zeros and get a score like any other; without a model
    every score is 0.5; equal texts score alike, bit for bit, wherever they are; a column ``name``
    is replaced, all others may have any name; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model, model.tables()))
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != name), T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, 1 << 20):
            texts = [t or b"" for t in part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
            score = np.full(len(texts), 0.5) if shared.value is None else shared.value[0].scores(texts, shared.value[1])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, name])

    return map_arrow(docs.drop(name).withColumn(text, F.col(text).cast("string")), run, schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))

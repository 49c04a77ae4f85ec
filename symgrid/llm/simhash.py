"""SimHash near-duplicate groups with covering locality-sensitive hashing.

A fingerprint is 64 bits. Bit i has a vector m(i) of radius + 1 bits; each non-zero vector v
gives a mask that keeps the bits whose m(i) has odd parity with v. The m(i) of at most
``radius`` differing bits span a space of at most ``radius`` dimensions, so some v is
orthogonal to all of them: its mask hides every difference and the pair collides in that
table. No pair within the radius is lost, whatever the data.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.llm.common import map_arrow, map_rows, small, stored, table
from symgrid.llm.components import connected_components

BITS = 64
RADIUS = 4
SHINGLE = 4
#: A bucket with more fingerprints is split by a second family of masks instead of compared.
BUCKET = 1024
#: Keys of shared buckets that are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Odd steps that assign bits to vectors anew for each family of masks.
STEPS = (1, 11, 27, 45)


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text's UTF-8 bytes; null and wordless texts give zero."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    starts = np.zeros(n, np.int64)
    np.cumsum(np.fromiter(map(len, words[:-1]), np.int64, n - 1) + 1, out=starts[1:])
    ends = np.append(starts[width:], len(joined) + 1) - 1
    pieces = map(joined.__getitem__, map(slice, starts[: n - width + 1].tolist(), ends.tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, n - width + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", *keep: str) -> DataFrame:
    """(doc_id, fp) of every row, and its longs ``keep``; fp is the fingerprint as a signed long."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "fp", *keep)])

    def rows(columns: list[list]) -> list[list]:
        return [columns[0], [x - (1 << 64) if x >> 63 else x for x in map(fingerprint, columns[1])], *columns[2:]]

    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *keep)
    return map_rows(own, ["doc_id", "text", *keep], rows, schema, ", ".join(f"{c} long" for c in schema.names), raw=True)


def covering_masks(radius: int = RADIUS, family: int = 0) -> list[int]:
    """2 ** (radius + 1) - 1 masks as signed longs; every set of ``radius`` bits is hidden by one."""
    n = (1 << (radius + 1)) - 1
    vectors = [(i * STEPS[family] + family * 7) % BITS % n + 1 for i in range(BITS)]
    masks = [sum(1 << i for i in range(BITS) if (vectors[i] & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_links(batch: pa.RecordBatch, radius: int) -> pa.RecordBatch:
    """Links that connect what is within ``radius`` in each bucket: fewer than its members."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for members in batch.column(0):
        x = np.unique(np.asarray(members.values, np.int64))
        left = np.ones(len(x), bool)
        while left.any():  # breadth first from any member that isn't reached yet
            first = int(np.argmax(left))
            left[first] = False
            queue = [first]
            while queue:
                at = queue.pop()
                rest = np.flatnonzero(left)
                near = rest[np.bitwise_count((x[rest] ^ x[at]).view(np.uint64)) <= radius]
                if len(near):
                    left[near] = False
                    queue.extend(near.tolist())
                    a.append(np.full(len(near), x[at]))
                    b.append(x[near])
    empty = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or [empty])), pa.array(np.concatenate(b or [empty]))], names=["a", "b"])


def links(fingerprints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that keep every component of "within radius".

    Tables whose masked keys no other fingerprint shares are dropped after a count that is
    combined before the shuffle. Buckets up to ``bucket`` are compared inside one task and give
    a spanning forest, never all pairs. Larger ones go through the next family of masks, which
    has the same guarantee and leaves half as many bits free: after the third at most some 2^8
    fingerprints can share a key, so no bucket needs a cap.
    """
    keys, out = fingerprints.select(F.lit(0).cast("long").alias("key"), "fp"), None
    for family in range(3):
        masked: Column = F.transform(F.array(*[F.lit(m).cast("long") for m in covering_masks(radius, family)]), lambda m: F.col("fp").bitwiseAND(m))
        tables = keys.select("key", "fp", F.posexplode(masked)).select(F.xxhash64("key", "pos", "col").alias("key"), "fp")
        shared = stored(tables.groupBy("key").count().where("count > 1"), f"simhash-keys{family}")
        few = small(shared, BROADCAST_KEYS)
        members = tables.join(F.broadcast(shared) if few else shared, "key")
        last = family == 2
        groups = (members if last else members.where(F.col("count") <= bucket)).groupBy("key").agg(F.collect_list("fp").alias("members"))
        found = map_arrow(groups.select("members"), lambda batches: (spanning_links(x, radius) for x in batches), "a long, b long").distinct()
        out = found if out is None else out.unionByName(found)
        if last or not shared.where(F.col("count") > bucket).head(1):
            return out.distinct() if family else out
        keys = stored(members.where(F.col("count") > bucket).select("key", "fp"), f"simhash-hot{family}")
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``, one row per input row.

    Components are those of "fingerprints differ in at most ``radius`` bits"; component_id is the
    smallest doc_id in the component. Copies share one fingerprint, so a group of any size is one
    vertex. Null and empty texts have fingerprint zero and are linked like any other; repeated
    rows give repeated results; a null doc_id never is a component_id unless its component has no
    other. Other columns are ignored; an empty table gives an empty result.
    """
    prints = stored(with_fingerprints(docs, text, id), "simhash")
    rooted = _rooted(prints, radius)
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, rep, root) of every fingerprint: its smallest doc_id and the fingerprint its component is named by."""
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    roots = connected_components(links(reps.select("fp"), radius))
    return reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest doc_id.

    Of several rows with that doc_id, the one whose text has the smallest fingerprint and then
    XXH64 stays, and one of equal texts. Rows without a doc_id take part in groups but never stand
    for one that has a doc_id; of a group of such rows alone one stays. Columns may have any name; an
    empty table gives an empty result.
    """
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    hashed = named.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("mark"))
    # What stands for a group is the least (doc_id, mark): texts don't move, and every row of a group counts before the shuffle.
    prints = stored(with_fingerprints(hashed, "text", "doc_id", "mark"), "simhash")
    rooted = _rooted(prints, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "mark"))
    small_marks = prints.groupBy("fp").agg(first.alias("x")).join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("x").alias("x"))
    chosen = stored(small_marks.select("x.doc_id", "x.mark"), "simhash-first")
    # Names of kept documents grow with the corpus: they are never broadcast, so every size has the same plan.
    own = named.select("row", "doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("mark"))
    kept = own.join(chosen.hint("merge"), own["doc_id"].eqNullSafe(chosen["doc_id"]) & (own["mark"] == chosen["mark"]), "left_semi")
    if prints.groupBy("doc_id", "mark").count().where("count > 1").head(1):
        kept = kept.dropDuplicates(["doc_id", "mark"])
    return kept.select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""References resolved to definitions by name, and the ranks that follow.

A reference to a name with N defining files gives 1/N to each of them but its own. Written as a
join of references with definers that is |refs| x N rows; here the name stands between: what a
file is owed for a name is (all references to it - its own) / N, so every join is on a name
with one row a side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from symgrid.functions.text import in_focus, is_test_path, tail_of
from symgrid.plans.storage import kept

EXPORT_WEIGHT, TEST_WEIGHT = 0.5, 0.3
DAMPING, ITERATIONS, TOLERANCE = 0.85, 100, 1e-8
STRATEGIES = ("simple", "pagerank")
#: Definers in one list of edges, and pairs that one task adds up.
LISTED, PAIRS = 1024, 1_000_000


def definers(defs: DataFrame, parts: int | None = None) -> DataFrame:
    """(name, path): each file once for every name it defines, qualified and by its last segment; by name in ``parts`` partitions, if given."""
    rows = defs.select("path", F.explode(F.array_distinct(F.array("name", tail_of("name")))).alias("name"))
    return (rows.repartition(parts, "name") if parts else rows).distinct().select("name", "path")


def definer_counts(defs: DataFrame) -> DataFrame:
    """(name, n): how many files define it."""
    return definers(defs).groupBy("name").agg(F.count("*").alias("n"))


def reference_counts(refs: DataFrame, parts: int | None = None) -> DataFrame:
    """(path, name, r): references of a file to a name, each (kind, line) once.

    Rows meet by (path, name) from the start, so that both steps share one shuffle.
    """
    rows = refs.select("path", "name", "kind", "line")
    rows = rows.repartition(parts, "path", "name") if parts else rows.repartition("path", "name")
    return rows.distinct().groupBy("path", "name").agg(F.count("*").alias("r"))


def reference_edges(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """(src, dst, weight) of the file graph; quadratic in a name's users and definers, so for graphs that are wanted as such.

    Definers travel as lists of at most some ``LISTED`` to the files that refer to them, so that pairs
    arise where they are added up and none of them is shuffled. As many tasks as the pairs ask for.
    """
    d = definers(defs)
    n = d.groupBy("name").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("path"), F.ceil(F.col("n") / LISTED)).alias("block")
    listed = kept(d.join(n, "name").groupBy("name", "n", block).agg(F.collect_list("path").alias("dsts")).drop("block"), "edge-definers")
    r = kept(reference_counts(refs), "edge-references")
    users = r.groupBy("name").agg(F.count("*").alias("users"))
    pairs = users.join(listed.groupBy("name").agg(F.max("n").alias("n")), "name").agg(F.sum(F.col("users") * F.col("n"))).first()[0] or 0
    parts = max(int(defs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
    sent = r.join(listed, "name").select(F.col("path").alias("src"), (F.col("r") / F.col("n")).alias("share"), "dsts").repartition(parts, "src")
    each = sent.select("src", "share", F.explode("dsts").alias("dst")).where("src <> dst")
    return each.groupBy("src", "dst").agg(F.sum("share").alias("weight"))


def inbound_credit(files: DataFrame, defs: DataFrame, refs: DataFrame, parts: int | None = None) -> DataFrame:
    """(path, credit) of every file. Definers and references meet by name, in one shuffle of both."""
    d = definers(defs, parts).select("path", "name", F.lit(1).alias("own"), F.lit(0).cast("long").alias("r"))
    both = d.unionByName(reference_counts(refs, parts).select("path", "name", F.lit(0).alias("own"), "r"))
    both = (both.repartition(parts, "name") if parts else both.repartition("name")).groupBy("name", "path").agg(F.max("own").alias("own"), F.sum("r").alias("r"))
    totals = both.groupBy("name").agg(F.sum("own").alias("n"), F.sum("r").alias("t")).where("n > 0 and t > 0")
    return credited(files, both.where("own = 1"), totals)


def credited(files: DataFrame, owned: DataFrame, totals: DataFrame) -> DataFrame:
    """(path, credit) of every file from ``owned`` (path, name, r: a file's own references to what it defines) and ``totals`` (name, n, t)."""
    credit = owned.join(totals, "name").groupBy("path").agg(F.sum((F.col("t") - F.col("r")) / F.col("n")).alias("credit"))
    return files.select("path").join(credit, "path", "left").select("path", F.coalesce("credit", F.lit(0.0)).alias("credit"))


def export_fraction(files: DataFrame, defs: DataFrame) -> DataFrame:
    """(path, fraction): exported share of a file's definitions, 0 if it has none."""
    share = defs.groupBy("path").agg(F.avg(F.col("exported").cast("double")).alias("fraction"))
    return files.select("path").join(share, "path", "left").select("path", F.coalesce("fraction", F.lit(0.0)).alias("fraction"))


def simple_rank(files: DataFrame, defs: DataFrame, refs: DataFrame) -> DataFrame:
    """(path, rank): credit, more for exported names, less for tests."""
    return ranked_by(inbound_credit(files, defs, refs).join(export_fraction(files, defs), "path"))


def ranked_by(parts: DataFrame) -> DataFrame:
    """(path, rank) of ``parts`` (path, credit, fraction)."""
    rank = F.col("credit") + EXPORT_WEIGHT * F.col("fraction") - F.when(is_test_path("path"), TEST_WEIGHT).otherwise(0.0)
    return parts.select("path", rank.alias("rank"))


def page_rank(
    files: DataFrame, defs: DataFrame, refs: DataFrame, personalize: Sequence[str] = (), damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, parts: int | None = None
) -> DataFrame:
    """(path, rank): PageRank of the file graph, its mass restarting in the focus if there is one.

    Works on the name-bipartite form and never builds the edges. Files without an edge to another
    file give their mass to the restart. Whether there is such an edge is counted in integers, so
    it doesn't hang on a rounded difference.

    A file that defines nothing gets the restart alone, so after the first step its score is a
    number a step times its restart. What such files give others is therefore summed up once: ``u``
    from the even start and ``v`` from a whole restart. Only files that both define and refer (the
    core) are followed step by step; without any, all steps are numbers on the driver.
    """
    paths = files.select("path").distinct()
    count = paths.count()
    if not count:
        return paths.select("path", F.lit(0.0).alias("rank"))
    d = definers(defs, parts)
    n = d.groupBy("name").agg(F.count("*").alias("n"))
    d = kept(d.join(n, "name").select("path", "name", "n"), "rank-definers")
    n = d.groupBy("name").agg(F.max("n").alias("n"))
    own = d.select("path", "name", F.lit(1).alias("own"))
    r = reference_counts(refs, parts)
    both = r.withColumn("own", F.lit(0)).unionByName(own.withColumn("r", F.lit(0)), allowMissingColumns=True)
    both = (both.repartition(parts, "name") if parts else both).groupBy("path", "name").agg(F.sum("r").alias("r"), F.max("own").alias("own")).where("r > 0")
    r = kept(both.join(n, "name").select("path", "name", "r", "n", "own"), "rank-references")
    out = r.groupBy("path").agg(F.sum(F.col("r") * (F.col("n") - F.col("own")) / F.col("n")).alias("weight"), F.max((F.col("n") > F.col("own")).cast("int")).alias("linked"))
    chosen = in_focus("path", personalize) if personalize else F.lit(True)
    marked = paths.withColumn("chosen", chosen)
    focused = marked.where("chosen").count()
    if not focused:
        marked, focused = paths.withColumn("chosen", F.lit(True)), count
    defining = d.select("path").distinct().withColumn("defines", F.lit(True))
    base = marked.join(out, "path", "left").join(defining, "path", "left")
    base = base.select("path", F.when(F.col("chosen"), 1.0 / focused).otherwise(0.0).alias("restart"), F.when(F.col("linked") == 1, F.col("weight")).alias("weight"), F.coalesce("defines", F.lit(False)).alias("defines"))
    base = kept(base, "rank-files")
    sources = base.where("weight is not null and not defines").select("path", (damping / count / F.col("weight")).alias("u"), (damping * F.col("restart") / F.col("weight")).alias("v"))
    sums = r.join(sources, "path").groupBy("name").agg(F.sum(F.col("u") * F.col("r")).alias("u"), F.sum(F.col("v") * F.col("r")).alias("v"))
    given = d.join(sums, "name").groupBy("path").agg(F.sum(F.col("u") / F.col("n")).alias("u"), F.sum(F.col("v") / F.col("n")).alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    base = kept(base.join(given, "path", "left").select("path", "restart", "weight", (F.col("defines") & F.col("weight").isNotNull()).alias("core"), zero("u"), zero("v")), "rank-base")
    lost = F.col("weight").isNull()
    z = base.agg(F.count(F.when(lost, 1)).alias("n"), *(F.coalesce(F.sum(F.when(lost, F.col(c))), F.lit(0.0)).alias(c) for c in ("restart", "u", "v")), F.max("core").alias("core")).first()
    if not z["core"]:
        return _steps_in_numbers(base, z, count, damping, iterations, tolerance)
    core = base.where("core").select("path")
    r = kept(r.join(core, "path", "left_semi"), "rank-core")
    d = kept(d.join(r.select("name").distinct(), "name", "left_semi"), "rank-core-definers")
    score, before, dangling = base.withColumn("score", F.lit(1.0 / count)), None, z["n"] / count
    for _ in range(iterations):
        sent = score.where("core").select("path", (damping * F.col("score") / F.col("weight")).alias("m"))
        mass = r.join(sent, "path").select("path", "name", "n", "own", (F.col("m") * F.col("r")).alias("give"))
        total = mass.groupBy("name").agg(F.sum("give").alias("all"))
        got = d.join(total, "name").select("path", (F.col("all") / F.col("n")).alias("got")).unionByName(mass.where("own = 1").select("path", (-F.col("give") / F.col("n")).alias("got")))
        got = got.groupBy("path").agg(F.sum("got").alias("got"))
        share = 1 - damping + damping * dangling
        rest = F.col("u") if before is None else before * F.col("v")
        new = score.join(got, "path", "left").select(*base.columns, F.col("score").alias("last"), (share * F.col("restart") + rest + F.coalesce("got", F.lit(0.0))).alias("score"))
        new = kept(new, "rank-step")
        ends = new.agg(F.sum(F.abs(F.col("score") - F.col("last"))).alias("change"), F.sum(F.when(lost, F.col("score"))).alias("dangling")).first()
        score, before, dangling = new.drop("last"), share, ends["dangling"] or 0.0
        if ends["change"] < tolerance:
            break
    return score.select("path", F.col("score").alias("rank"))


def _steps_in_numbers(base: DataFrame, lost: Row, count: int, damping: float, iterations: int, tolerance: float) -> DataFrame:
    """(path, rank) where nothing both defines and refers: step k gives ``a[k] restart + a[k - 1] v``, the first ``a[0] restart + u``."""
    share = lambda mass: 1 - damping + damping * mass
    a, dangling = [], lost["n"] / count
    for k in range(iterations):
        a.append(share(dangling))
        dangling = a[k] * lost["restart"] + (lost["u"] if k == 0 else a[k - 1] * lost["v"])
    parts = [(0.0, 0.0, 0.0, 1.0 / count), *((a[k], float(k == 0), a[k - 1] if k else 0.0, 0.0) for k in range(iterations))]  # of restart, u, v and 1
    at = lambda x: F.lit(x[0]) * F.col("restart") + F.lit(x[1]) * F.col("u") + F.lit(x[2]) * F.col("v") + F.lit(x[3])
    last = iterations
    for first in range(0, iterations if tolerance > 0 else 0, 10):
        these = range(first, min(first + 10, iterations))
        changes = base.agg(*(F.sum(F.abs(at([y - x for x, y in zip(parts[k], parts[k + 1], strict=True)]))).alias(f"c{k}") for k in these)).first()
        done = [k + 1 for k in these if changes[f"c{k}"] < tolerance]
        if done:
            last = done[0]
            break
    return base.select("path", at(parts[last]).alias("rank"))


def ranks(files: DataFrame, defs: DataFrame, refs: DataFrame, strategy: str = "simple", personalize: Sequence[str] = ()) -> DataFrame:
    """(path, rank) by a named strategy; a focus only matters to PageRank."""
    if strategy == "simple":
        return simple_rank(files, defs, refs)
    if strategy == "pagerank":
        return page_rank(files, defs, refs, personalize)
    raise ValueError(f"unknown rank strategy {strategy!r}; expected one of {', '.join(STRATEGIES)}")


def with_ranks(files: DataFrame, rank: DataFrame) -> DataFrame:
    """Files with their rank, 0 where there is none."""
    return files.drop("rank").join(rank.select("path", "rank"), "path", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))

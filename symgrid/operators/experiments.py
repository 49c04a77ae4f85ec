"""Paired-experiment analytics over run records: summaries, quartiles, censoring, traces, graders, cost."""

from __future__ import annotations

import random
import statistics
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgrid.functions import text as X

ARMS = ("baseline", "treatment")
CONTROL = "E"
LOOKUP, READ = "lookup", "read_file"
WORDS = 1 << 20  # drawn at a time


def exclusive_quartiles(values: Column) -> tuple[Column, Column]:
    """First and third quartile of an array, interpolated at q (n + 1); the extremes below four values."""
    v, n = F.array_sort(values), F.size(values)

    def at(q: int) -> Column:
        place = q * (n + 1)
        j = F.least(F.greatest(F.floor(place / 4).cast("int"), F.lit(1)), n - 1)
        rest = place - j * 4
        return (F.get(v, j - 1) * (4 - rest) + F.get(v, j) * rest) / F.lit(4.0)

    return F.when(n < 4, F.get(v, F.lit(0))).otherwise(at(1)), F.when(n < 4, F.get(v, n - 1)).otherwise(at(3))


def inclusive_quartiles(values: Column) -> tuple[Column, Column, Column]:
    """Quartiles and median, aggregated as Spark's percentile does; the extremes below four values."""
    small = F.count(values) < 4
    p = F.percentile(values, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return zero(F.when(small, F.min(values)).otherwise(p[0])), zero(p[1]), zero(F.when(small, F.max(values)).otherwise(p[2]))


def _failed() -> Column:
    return F.coalesce(F.col("failure_reason") != "", F.lit(False))


def arm_summaries(runs: DataFrame) -> DataFrame:
    """(task_id, arm) with n, median tokens, quartiles, median turns, censored and the last category.

    A task has as many runs as trials were made, so its tokens fit one row.
    """
    grouped = runs.groupBy("task_id", "arm").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.col("input_tokens").cast("double"))).alias("_v"), F.median("input_tokens").alias("median_tokens"),
        F.median(F.coalesce("turns", F.lit(0))).alias("median_turns"), F.max(_failed().cast("int")).alias("_failed"), F.max_by("category", F.struct("ts", "event_id")).alias("category"), F.max(F.struct("ts", "event_id")).alias("_last"),
    )
    q1, q3 = exclusive_quartiles(F.col("_v"))
    return grouped.select("task_id", "arm", "n", "median_tokens", q1.alias("q1"), q3.alias("q3"), "median_turns", (F.col("_failed") == 1).alias("censored"), "category", "_last")


def task_summaries(runs: DataFrame) -> DataFrame:
    """One row for each task that has both arms, with the share of tokens saved; null if there was nothing to save."""
    s = arm_summaries(runs)
    one = lambda arm: s.where(F.col("arm") == arm).select("task_id", *(F.col(c).alias(f"{arm}_{c}") for c in s.columns if c not in ("task_id", "arm")))
    both = one("baseline").join(one("treatment"), "task_id")
    b, t = F.col("baseline_median_tokens"), F.col("treatment_median_tokens")
    per = lambda arm: F.try_divide(f"{arm}_median_tokens", F.nullif(F.col(f"{arm}_median_turns"), F.lit(0.0)))
    later = F.when(F.col("treatment__last") > F.col("baseline__last"), F.col("treatment_category")).otherwise(F.col("baseline_category"))
    return both.select(
        "task_id", later.alias("category"), b.alias("baseline_median"), t.alias("treatment_median"), F.col("baseline_q1"), F.col("baseline_q3"), F.col("treatment_q1"), F.col("treatment_q3"),
        (F.col("baseline_n") + F.col("treatment_n")).alias("runs"), (F.col("baseline_censored") | F.col("treatment_censored")).alias("censored"),
        per("baseline").alias("baseline_per_turn"), per("treatment").alias("treatment_per_turn"), F.when(b > 0, (b - t) / b).alias("reduction"),
    )


def headline(summaries: DataFrame) -> DataFrame:
    """Paired, censored, control and counted tasks, and the median reduction of the counted ones."""
    usable = ~F.col("censored") & (F.col("category") != CONTROL)
    return summaries.agg(
        F.count("*").alias("tasks_paired"), F.count(F.when(F.col("censored"), 1)).alias("tasks_censored"), F.count(F.when(F.col("category") == CONTROL, 1)).alias("tasks_control"),
        F.count(F.when(usable, 1)).alias("tasks_in_headline"), F.median(F.when(usable, F.col("reduction"))).alias("median_reduction"),
    )


def by_category(summaries: DataFrame) -> DataFrame:
    """Tasks, censored tasks and median reduction of the others for each category."""
    return summaries.groupBy("category").agg(F.count("*").alias("tasks"), F.count(F.when(F.col("censored"), 1)).alias("censored"), F.median(F.when(~F.col("censored"), F.col("reduction"))).alias("median_reduction"))


def success_rates(runs: DataFrame) -> DataFrame:
    """(arm, wins, graded, total, rate): ungraded runs count in neither part of the rate."""
    return runs.groupBy("arm").agg(F.count(F.when(F.col("success"), 1)).alias("wins"), F.count("success").alias("graded"), F.count("*").alias("total"), F.avg(F.col("success").cast("double")).alias("rate"))


def arms_block(runs: DataFrame) -> DataFrame:
    """Runs, graded runs, rate, median tokens and failures of both arms, also of one without runs."""
    both = runs.sparkSession.createDataFrame([(a,) for a in ARMS], "arm string")
    own = runs.groupBy("arm").agg(
        F.count("*").alias("runs"), F.count("success").alias("graded"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.median("input_tokens").alias("median_input_tokens"),
        F.array_join(F.array_sort(F.collect_set(F.when(_failed(), F.col("failure_reason")))), ",").alias("failures"),
    )
    rows = F.broadcast(both).join(own, "arm", "left")
    return rows.select("arm", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("graded", F.lit(0)).alias("graded"), "success_rate", "median_input_tokens", F.coalesce("failures", F.lit("")).alias("failures"))


def integrity(runs: DataFrame) -> DataFrame:
    """Mean lookups of treatment runs, how many made none, and runs served from a cache."""
    treated, calls = F.col("arm") == "treatment", F.coalesce("lookup_calls", F.lit(0))
    cached = F.coalesce(F.col("cache_read_input_tokens") > 0, F.lit(False)) if "cache_read_input_tokens" in runs.columns else F.lit(False)
    return runs.agg(F.avg(F.when(treated, calls)).alias("mean_lookup_calls"), F.count(F.when(treated & (calls == 0), 1)).alias("runs_without_lookup"), F.count(F.when(cached, 1)).alias("cached_runs"))


def prompt_overhead(runs: DataFrame) -> DataFrame:
    """(pairs, overhead): median extra tokens a turn of tasks whose last runs made the same calls in both arms."""
    last = runs.groupBy("task_id", "arm").agg(F.max_by(F.struct("input_tokens", "turns", "tool_calls"), F.struct("ts", "event_id")).alias("r"))
    one = lambda arm: last.where(F.col("arm") == arm).select("task_id", F.col("r").alias(arm))
    both = one("baseline").join(one("treatment"), "task_id").where("baseline.tool_calls <=> treatment.tool_calls and baseline.turns > 0 and treatment.turns > 0")
    delta = F.col("treatment.input_tokens") / F.col("treatment.turns") - F.col("baseline.input_tokens") / F.col("baseline.turns")
    return both.agg(F.count("*").alias("pairs"), F.median(delta).alias("overhead"))


def substitution(trace: DataFrame, lookup: str = LOOKUP, read: str = READ) -> DataFrame:
    """(calls, followed_by_read, rate): how often a lookup is followed at once by reading a file."""
    then = F.lead("name").over(Window.partitionBy("run").orderBy("ts", "event_id"))
    marked = trace.withColumn("_then", then).where(F.col("name") == lookup)
    rows = marked.agg(F.count("*").alias("calls"), F.count(F.when(F.col("_then") == read, 1)).alias("followed_by_read"))
    return rows.withColumn("rate", F.try_divide("followed_by_read", "calls"))


def subcommands(trace: DataFrame, lookup: str = LOOKUP) -> DataFrame:
    """(subcommand, n, place): most common first words of lookups, earlier ones first among equals."""
    word = F.substring_index(F.coalesce("arg", F.lit("")), " ", 1)
    counts = trace.where(F.col("name") == lookup).groupBy(F.when(word == "", "?").otherwise(word).alias("subcommand")).agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("_first"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "_first"))).drop("_first")  # few rows: one a command


def _resampled_medians(values: Sequence[float], iterations: int, seed: int) -> Iterator[float]:
    """Medians of resamples drawn by ``random.Random(seed).randrange``, many words of its generator at a time.

    randrange(n) takes the upper bits of 32-bit words until they are under n. numpy's generator has the
    same words from the same state. Medians are taken of the places in sorted order.
    """
    n = len(values)
    if n.bit_length() > 32 or any(v != v for v in values):
        draw = random.Random(seed)
        yield from (statistics.median([values[draw.randrange(n)] for _ in values]) for _ in range(iterations))
        return
    ordered = sorted(values)
    place = np.empty(n, np.int64)
    place[sorted(range(n), key=values.__getitem__)] = np.arange(n)
    *words, at = random.Random(seed).getstate()[1]
    source = np.random.MT19937()
    source.state = {"bit_generator": "MT19937", "state": {"key": np.array(words, np.uint32), "pos": at}}
    shift, half = 32 - n.bit_length(), n // 2
    left = np.empty(0, np.int64)
    rows = max(1, WORDS // n)
    for done in range(0, iterations, rows):
        need = min(rows, iterations - done) * n
        taken, have = [left], len(left)
        while have < need:
            drawn = (source.random_raw(min(WORDS, 2 * (need - have) + 64)) >> shift).astype(np.int64)
            drawn = drawn[drawn < n]
            taken.append(drawn)
            have += len(drawn)
        drawn = np.concatenate(taken)
        drawn, left = drawn[:need], drawn[need:]
        block = np.partition(place[drawn].reshape(-1, n), [half - 1, half] if n % 2 == 0 else [half], axis=1)
        if n % 2:
            yield from (ordered[k] for k in block[:, half])
        else:
            yield from ((ordered[a] + ordered[b]) / 2 for a, b in zip(block[:, half - 1], block[:, half], strict=True))


def bootstrap_interval(values: Sequence[float], confidence: float = 0.95, iterations: int = 10_000, seed: int = 1) -> tuple[float, float]:
    """Percentile interval of the median under resampling, with Python's own generator so that a seed fixes it."""
    if not values:
        raise ValueError("nothing to resample")
    if len(values) == 1:
        return values[0], values[0]
    medians = sorted(_resampled_medians(values, iterations, seed))
    tail = (1 - confidence) / 2
    return medians[int(tail * iterations)], medians[min(iterations - 1, int((1 - tail) * iterations))]


def bootstrap_by(df: DataFrame, key: str, value: str, order: str, iterations: int = 10_000, seed: int = 1) -> DataFrame:
    """(key, low, high) of each group, one task a group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_interval(group.sort_values(order)[value].tolist(), iterations=iterations, seed=seed)
        return pd.DataFrame({key: [group[key].iloc[0]], "low": [low], "high": [high]})

    return df.where(F.col(value).isNotNull()).select(key, value, order).groupBy(key).applyInPandas(run, f"{key} string, low double, high double")


def usage_totals(turns: DataFrame) -> DataFrame:
    """Turns and tokens of each run, those read (user, system, tool) and those written by the assistant."""
    written = F.col("role") == "assistant"
    return turns.groupBy("run").agg(F.count("*").alias("turns"), F.sum(F.when(written, 0).otherwise(F.col("tokens"))).alias("input_tokens"), F.sum(F.when(written, F.col("tokens")).otherwise(0)).alias("output_tokens"))


def total_input(usage: DataFrame) -> Column:
    """All tokens read, cached or not."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in ("cache_read_input_tokens", "cache_creation_input_tokens") if c in usage.columns), F.coalesce(F.col("input_tokens"), F.lit(0)))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with ``cost`` in the prices' currency (per million tokens), null for a model without prices."""
    cost = (total_input(usage) * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / F.lit(1e6)
    return usage.join(F.broadcast(prices.limit(10_000)), "model", "left").select(*usage.columns, cost.alias("cost"))  # a price list, bounded


def run_matrix(tasks: DataFrame, trials: int, seed: int = 1) -> DataFrame:
    """(task_id, trial, arm, pos): every task and trial with both arms, the first one alternating.

    Order is a hash of task, trial and seed, so it's the same however tasks are partitioned.
    """
    pairs = tasks.select(F.col("id").alias("task_id"), F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    from symgrid.operators.display import numbered

    placed = numbered(pairs.withColumn("_h", F.xxhash64("task_id", "trial", F.lit(seed))), [F.col("_h"), F.col("task_id"), F.col("trial")], "pair").drop("_h")
    first, second = (F.when(F.col("pair") % 2 == odd, ARMS[0]).otherwise(ARMS[1]) for odd in (1, 0))
    each = placed.select("task_id", "trial", "pair", F.posexplode(F.array(first, second)).alias("k", "arm"))
    return each.select("task_id", "trial", "arm", (2 * (F.col("pair") - 1) + F.col("k") + 1).alias("pos"))


def shuffled_matrix(task_ids: Sequence[str], trials: int, seed: int = 1) -> list[tuple[str, int, str]]:
    """The matrix in the order of Python's own shuffle, for suites small enough to list."""
    pairs = [(t, k) for t in sorted(task_ids) for k in range(1, trials + 1)]
    random.Random(seed).shuffle(pairs)
    return [(t, k, arm) for i, (t, k) in enumerate(pairs) for arm in (ARMS if i % 2 == 0 else ARMS[::-1])]


def unfinished(matrix: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of the matrix that no record has yet."""
    return matrix.join(done.select("task_id", "arm", "trial").distinct(), ["task_id", "arm", "trial"], "left_anti")


def unknown_repos(tasks: DataFrame, repos: DataFrame) -> DataFrame:
    """Tasks of repositories that aren't listed."""
    return tasks.join(repos.select(F.col("name").alias("repo")), "repo", "left_anti")


def probe(found: DataFrame) -> DataFrame:
    """``found`` (show_tokens, file_tokens) with saved and ratio; ratio 0 for empty files, and negative where showing cost more."""
    saved = F.col("file_tokens") - F.col("show_tokens")
    return found.withColumn("saved", saved).withColumn("ratio", F.when(F.col("file_tokens") <= 0, 0.0).otherwise(saved / F.col("file_tokens")))


def first_of_each_name(defs: DataFrame, *more: str) -> DataFrame:
    """The first definition of each name in order of path, line, name and kind, with ``more`` of its columns."""
    first = F.min(F.struct("path", "line", "kind", "end_line", *more)).alias("f")  # combined before the shuffle, unlike a row number
    return defs.groupBy("name").agg(first).select("name", *(f"f.{c}" for c in ("path", "line", "kind", "end_line", *more)))


def probe_summary(probed: DataFrame) -> DataFrame:
    """Totals, pooled and median reduction with inclusive quartiles, and where showing was no gain."""
    q1, mid, q3 = inclusive_quartiles(F.col("ratio"))
    return probed.agg(
        F.count("*").alias("symbols"), F.sum("show_tokens").alias("show_tokens"), F.sum("file_tokens").alias("file_tokens"),
        F.try_divide(F.sum("saved"), F.sum("file_tokens")).alias("pooled_reduction"), mid.alias("median_reduction"), q1.alias("q1"), q3.alias("q3"), F.count(F.when(F.col("saved") <= 0, 1)).alias("worse_than_file"),
    )


def _said(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("/"))


def graded(runs: DataFrame) -> DataFrame:
    """``runs`` (final_text, diff, failure_reason, grade) with ``verdict`` and ``missing``.

    A run that was cut off fails. localization: every expected path is named. rubric: of every group
    one alternative, and every expected file, in the collapsed lower text. diff: expected files
    changed, added lines hold all of the wanted and none of the unwanted fragments. Others: null.
    """
    g = lambda f: F.coalesce(F.col(f"grade.{f}"), F.array())
    said, low = _said(F.col("final_text")), F.lower(X.collapsed(_said(F.col("final_text"))))
    missing = F.filter(g("expect_files"), lambda e: ~F.contains(said, X.normalised_path(e)))
    missing_low = F.filter(g("expect_files"), lambda e: ~F.contains(low, F.lower(X.normalised_path(e))))
    groups = F.filter(F.coalesce(F.col("grade.expect_all"), F.array().cast("array<array<string>>")), lambda alts: ~F.exists(alts, lambda a: F.contains(low, F.lower(X.collapsed(a)))))
    rows = F.split(F.coalesce("diff", F.lit("")), "\n")
    changed = F.transform(F.filter(rows, lambda r: F.startswith(r, F.lit("+++ b/"))), lambda r: F.substring(r, 7, 4096))
    added = F.array_join(added_lines(F.col("diff")), "\n")
    unchanged = F.array_except(g("expect_files"), changed)
    wanted = F.filter(g("expect_contains"), lambda x: ~F.contains(added, x))
    unwanted = F.filter(g("expect_absent"), lambda x: F.contains(added, x))
    kind = F.col("grade.kind")
    verdict = (
        F.when(_failed(), False).when(kind == "localization", F.size(missing) == 0).when(kind == "rubric", (F.size(groups) == 0) & (F.size(missing_low) == 0))
        .when(kind == "diff", (F.size(unchanged) == 0) & (F.size(wanted) == 0) & (F.size(unwanted) == 0))
    )
    lacking = F.when(kind == "localization", missing).when(kind == "rubric", F.concat(F.transform(groups, lambda a: F.array_join(a, "|")), missing_low)).when(kind == "diff", F.concat(unchanged, wanted))
    return runs.withColumn("verdict", verdict).withColumn("missing", F.array_join(F.coalesce(lacking, F.array()), ","))


def added_lines(diff: Column) -> Column:
    """Lines a unified diff adds, without their mark; file headers aren't lines."""
    rows = F.filter(F.split(F.coalesce(diff, F.lit("")), "\n"), lambda r: F.startswith(r, F.lit("+")) & ~F.startswith(r, F.lit("+++")))
    return F.transform(rows, lambda r: F.substring(r, 2, 1 << 30))


def grep(lines: DataFrame, regex: str, glob: str = "*", cap: int = 20_000) -> DataFrame:
    """(pos, content): matching lines as ./path:line:text, files in order, until ``cap`` characters are full."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    found = lines.where(F.col("content").rlike(regex) & name.rlike(X.glob_regex(glob)))
    text = F.concat(F.lit("./"), F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("content"))
    # Every line takes ten characters or more, so later ones can't be within the cap.
    near = found.select("path", "line", text.alias("content")).orderBy("path", "line").limit(cap // 10 + 1)
    before = F.coalesce(F.sum(F.char_length("content") + 1).over(Window.orderBy("path", "line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return near.select(F.row_number().over(Window.orderBy("path", "line")).alias("pos"), "content", before.alias("_before")).where(F.col("_before") <= cap).drop("_before")


def read_range(lines: DataFrame, path: str, offset: int = 1, limit: int = 2000) -> DataFrame:
    """(line, content) of a file from a line on, as number, tab, text."""
    own = lines.where((F.col("path") == path) & (F.col("line") >= offset) & (F.col("line") < offset + limit))
    return own.select("line", F.concat(F.col("line").cast("string"), F.lit("\t"), F.col("content")).alias("content"))


def edited(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, text, error): files with one edit each (find, replace); ``find`` must occur exactly once."""
    times = F.size(F.split("text", F.concat(F.lit("\\Q"), F.col("find"), F.lit("\\E")), -1)) - 1
    rows = files.join(edits, "path").withColumn("_times", times)
    text = F.when(F.col("_times") == 1, F.replace("text", F.col("find"), F.col("replace"))).otherwise(F.col("text"))
    error = F.when(F.col("_times") == 0, "not found").when(F.col("_times") > 1, F.concat(F.lit("found "), F.col("_times").cast("string"), F.lit(" times")))
    return rows.select("path", text.alias("text"), error.alias("error"))


def refresh_plan(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, action): reuse an equal file, parse a new or changed one, drop a vanished one."""
    a = stored.select("path", F.col("sha256").alias("_old"))
    b = listed.select("path", F.col("sha256").alias("_new"))
    action = F.when(F.col("_new").isNull(), "drop").when(F.col("_old") == F.col("_new"), "reuse").otherwise("parse")
    return a.join(b, "path", "full_outer").select("path", action.alias("action"))

"""Run records, tasks and repositories: JSON sources and sinks with explicit schemas."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.schemas import REPOS, RUNS, TASKS

GRADES = {
    "localization": {"kind", "expect_files"},
    "rubric": {"kind", "expect_all", "expect_files"},
    "diff": {"kind", "expect_files", "expect_contains", "expect_absent"},
    "tests": {"kind", "command"},
}
TASK_KEYS = {"id", "repo", "category", "prompt", "grade", "setup", "source"}
CATEGORIES = frozenset("ABCDE")


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records of JSON Lines; keys a record lacks are null, blank lines don't count, no record at all is an error."""
    runs = spark.read.schema(RUNS).json(path).where("task_id is not null")
    if not runs.head(1):
        raise ValueError(f"{path} contains no runs")
    return runs


def append_runs(runs: DataFrame, path: str) -> None:
    """Add records, failed ones too; nothing is rewritten."""
    runs.write.mode("append").json(path)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, arm, trial) that have a record; none if there is no file yet."""
    if not os.path.exists(path):
        return spark.createDataFrame([], "task_id string, arm string, trial int")
    return spark.read.schema(RUNS).json(path).select("task_id", "arm", "trial").where("task_id is not null").distinct()


def task_problems(raw: DataFrame) -> DataFrame:
    """(file, problem) of task documents (file, document): missing or unknown keys, kinds, categories and rubrics."""
    keys = F.json_object_keys("document")
    text = lambda p: F.get_json_object("document", p)
    kind = text("$.grade.kind")
    allowed = F.lit(None).cast("array<string>")
    for name, fields in GRADES.items():
        allowed = F.when(kind == name, F.array(*map(F.lit, sorted(fields)))).otherwise(allowed)
    required = F.array(*map(F.lit, ("id", "repo", "category", "prompt", "grade")))
    problems = F.array(
        F.when(keys.isNull(), "not a JSON object"),
        F.when(F.size(F.array_except(required, keys)) > 0, F.concat(F.lit("missing keys: "), F.array_join(F.array_except(required, keys), ", "))),
        F.when(F.size(F.array_except(keys, F.array(*map(F.lit, sorted(TASK_KEYS))))) > 0, F.concat(F.lit("unknown keys: "), F.array_join(F.array_except(keys, F.array(*map(F.lit, sorted(TASK_KEYS)))), ", "))),
        F.when(keys.isNotNull() & allowed.isNull(), F.concat(F.lit("unknown grader: "), F.coalesce(kind, F.lit("")))),
        F.when(F.size(F.array_except(F.json_object_keys(text("$.grade")), allowed)) > 0, F.concat(F.lit("unknown grader keys: "), F.array_join(F.array_except(F.json_object_keys(text("$.grade")), allowed), ", "))),
        F.when(~F.upper(text("$.category")).isin(*sorted(CATEGORIES)), "unknown category"),
        F.when((kind == "rubric") & text("$.grade.expect_all").rlike(r"^\[\s*\]$|\[\s*\[\s*\]|,\s*\[\s*\]"), "a rubric group is empty"),
    )
    return raw.select("file", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def load_tasks(spark: SparkSession, folder: str, repo: str | None = None, categories: str = "", ids: tuple[str, ...] = ()) -> DataFrame:
    """Tasks of a folder of JSON documents, by id; filters hold together; a wrong or doubled task or no task is an error."""
    raw = spark.read.option("wholetext", True).text(f"{folder}/*.json").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("document"))
    wrong = task_problems(raw).orderBy("file").take(1)
    if wrong:
        raise ValueError(f"{wrong[0]['file']}: {wrong[0]['problem']}")
    tasks = raw.select(F.from_json("document", TASKS).alias("t")).select("t.*").withColumn("category", F.upper("category"))
    twice = tasks.groupBy("id").count().where("count > 1").orderBy("id").take(1)
    if twice:
        raise ValueError(f"duplicate task id {twice[0]['id']}")
    if repo:
        tasks = tasks.where(F.col("repo") == repo)
    if categories:
        tasks = tasks.where(F.col("category").isin(*re.findall(r"\w", categories.upper())))
    if ids:
        tasks = tasks.where(F.col("id").isin(*ids))
    if not tasks.head(1):
        raise ValueError("no task matches")
    return tasks.orderBy("id")


def load_repos(spark: SparkSession, path: str) -> DataFrame:
    """Repositories of a JSON object by name; url and sha are required."""
    body = spark.read.option("wholetext", True).text(path)
    rows = body.select(F.explode(F.from_json("value", "map<string,struct<url:string,sha:string,test_command:string>>")).alias("name", "r")).select("name", "r.*")
    wrong = rows.where("url is null or sha is null").take(1)
    if wrong:
        raise ValueError(f"repository {wrong[0]['name']} needs url and sha")
    return rows.to(spark.createDataFrame([], REPOS).schema)


def guidance(text: str) -> str:
    """The section of a guide from "## When to use it" up to "## Commands"."""
    found = re.search(r"(?ms)^## When to use it$.*?(?=^## Commands$)", text)
    if not found:
        raise ValueError("the guide has no such section")
    return found[0].strip()

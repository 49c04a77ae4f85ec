"""Operators on small tables with known answers."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symgrid.functions import text as X
from symgrid.operators import display as D
from symgrid.operators import experiments as E
from symgrid.operators import resolve as R

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def python_tokens(text: str) -> int:
    import regex

    return sum(-(-len(p) // 3) if regex.match(r"[\p{L}\p{N}_]", p) else 1 for p in regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\s+", text))


def graph(spark, defs, refs, files=None):
    d = spark.createDataFrame([(p, n, "function", i + 1, True) for i, (p, n) in enumerate(defs)], "path string, name string, kind string, line int, exported boolean")
    r = spark.createDataFrame([(p, n, "call", i + 1) for i, (p, n) in enumerate(refs)], "path string, name string, kind string, line int")
    f = spark.createDataFrame([(p,) for p in sorted(files or {x for x, _ in defs} | {x for x, _ in refs})], "path string")
    return f, d, r


def test_paths(spark):
    cases = {"tests/a.py": True, "src/test/a.py": True, "src/test_a.py": True, "a_test.go": True, "a.spec.ts": True, "src/a.py": False, "contest/a.py": False, "src/latest.py": False}
    got = dict(map(tuple, spark.createDataFrame([(k,) for k in cases], "p string").select("p", X.is_test_path("p")).collect()))
    assert got == cases
    assert one(spark, X.normalised_path(F.lit(".\\./src\\a.py"))) == "src/a.py"
    assert one(spark, X.normalised_path(F.lit(".github/x"))) == ".github/x"
    assert one(spark, X.in_focus(F.lit("src_a/b"), ["src"])) is False and one(spark, X.in_focus(F.lit("src/b"), ["./src/", ""])) is True
    assert [one(spark, X.language_of(F.lit(p))) for p in ("a.PY", "b.tsx", "c.mjs", "d.md", "e")] == ["python", "tsx", "javascript", None, None]


def test_names_and_texts(spark):
    assert one(spark, X.tail_of(F.lit("a.b.c"))) == "c" and one(spark, X.parent_of(F.lit("a.b.c"))) == "a.b" and one(spark, X.parent_of(F.lit("a"))) == ""
    assert [one(spark, X.line_count(F.lit(t))) for t in ("", "a", "a\n", "a\nb", "\n")] == [0, 1, 1, 2, 1]
    assert one(spark, X.tidied(F.lit("def f( a: int, b: str, ) -> list[ str ]"))) == "def f(a: int, b: str) -> list[str]"
    assert one(spark, X.shortened(F.lit("abcdefgh "), 8)) == "abcde..." and one(spark, X.shortened(F.lit("abc"), 3)) == "abc"
    assert one(spark, X.byte_capped(F.lit("aé€"), 5)) == "aé" and one(spark, X.looks_binary(F.lit("x"))) is True
    for pattern, yes, no in (("*_client", "http_client", "client"), ("a?c", "abc", "ac"), ("[!x]y", "ay", "xy"), ("a[b-d]", "ac", "ae"), ("x[", "x[", "x")):
        assert one(spark, F.lit(yes).rlike(X.glob_regex(pattern))) and not one(spark, F.lit(no).rlike(X.glob_regex(pattern)))


@FEW
@given(st.lists(st.text(alphabet="ab_é1 .,\n\t中()", max_size=30), min_size=1, max_size=20))
def test_token_count_is_the_rule(spark, texts):
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.token_count("t")).collect()]
    assert got == [python_tokens(t) for t in texts]


@FEW
@given(st.lists(st.text(alphabet="ab _é.(", min_size=1, max_size=12).filter(str.strip), min_size=1, max_size=12), st.integers(0, 60))
def test_fitted_is_the_longest_prefix(spark, lines, budget):
    rows = spark.createDataFrame(list(enumerate(lines)), "pos int, content string")
    got = D.fitted(rows, budget).orderBy("is_marker", "pos").collect()
    kept = [r["content"] for r in got if not r["is_marker"]]

    def cost(xs):
        return python_tokens("\n".join(xs))

    if budget > 0 and cost(lines) <= budget:
        want = lines
    else:
        want = next((lines[:n] for n in range(len(lines) - 1, -1, -1) if cost([*lines[:n], D.MARKER]) <= budget), [])
    assert kept == want


def test_marker_costs_what_is_said(spark):
    assert one(spark, X.token_count(F.lit(D.MARKER))) == D.MARKER_COST


def test_credit_is_shared(spark):
    files, defs, refs = graph(spark, [("a", "f"), ("b", "f"), ("c", "f"), ("d", "C.g")], [("x", "f"), ("a", "f"), ("x", "g")])
    got = {r["path"]: r["credit"] for r in R.inbound_credit(files, defs, refs).collect()}
    assert got == pytest.approx({"a": 1 / 3, "b": 2 / 3, "c": 2 / 3, "d": 1.0, "x": 0.0})
    twice = graph(spark, [("a", "f"), ("a", "f")], [("x", "f")])
    assert {r["path"]: r["credit"] for r in R.inbound_credit(*twice).collect()} == {"a": 1.0, "x": 0.0}


def test_simple_rank(spark):
    files = spark.createDataFrame([("a.py",), ("tests/t.py",)], "path string")
    defs = spark.createDataFrame([("a.py", "f", True), ("a.py", "_g", False)], "path string, name string, exported boolean")
    refs = spark.createDataFrame([("tests/t.py", "f", "call", i) for i in (1, 2)], "path string, name string, kind string, line int")
    assert {r["path"]: r["rank"] for r in R.ranks(files, defs, refs).collect()} == pytest.approx({"a.py": 2.25, "tests/t.py": -0.3})
    with pytest.raises(ValueError):
        R.ranks(files, defs, refs, "other")


def dense_page_rank(paths, edges, focus=(), damping=0.85, steps=100, tol=1e-8):
    n, at = len(paths), {p: i for i, p in enumerate(paths)}
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[at[a], at[b]] += x
    tele = np.array([1.0 if not focus or p in focus else 0.0 for p in paths])
    tele /= tele.sum()
    out, s = w.sum(1), np.full(n, 1 / n)
    for _ in range(steps):
        new = (1 - damping) * tele + damping * s[out == 0].sum() * tele + damping * ((s[out > 0] / out[out > 0]) @ w[out > 0])
        change, s = abs(new - s).sum(), new
        if change < tol:
            break
    return dict(zip(paths, s))


@pytest.mark.parametrize("focus", [(), ("p1",)])
def test_page_rank_equals_the_pairwise_form(spark, focus):
    r = random.Random(3)
    defs = sorted({(f"p{r.randrange(8)}", f"n{r.randrange(12)}") for _ in range(16)})
    refs = [(f"p{r.randrange(10)}", f"n{r.randrange(14)}") for _ in range(40)]
    files, d, f = graph(spark, defs, refs, {f"p{i}" for i in range(10)})
    edges = [(e["src"], e["dst"], e["weight"]) for e in R.reference_edges(d, f).collect()]
    want = dense_page_rank([f"p{i}" for i in range(10)], edges, focus)
    got = {x["path"]: x["rank"] for x in R.page_rank(files, d, f, focus).collect()}
    assert got == pytest.approx(want, abs=1e-7) and sum(got.values()) == pytest.approx(1)


def test_symbols_follow_their_parents(spark):
    rows = [("run", "function", 30, True), ("Widget", "class", 10, True), ("Widget.draw", "method", 12, True), ("Widget.draw.inner", "function", 13, False), ("MAX", "constant", 1, True), ("_helper", "function", 2, False), ("Lost.m", "method", 40, True)]
    defs = spark.createDataFrame([("a.py", n, k, ln, ln, n, "", x) for n, k, ln, x in rows], "path string, name string, kind string, line int, end_line int, signature string, doc string, exported boolean")
    got = [(r["name"], r["depth"]) for r in D.ordered_symbols(defs).orderBy("pos").collect()]
    assert got == [("Widget", 0), ("Widget.draw", 1), ("Widget.draw.inner", 2), ("run", 0), ("Lost.m", 0), ("MAX", 0), ("_helper", 0)]


def test_map_grows_with_the_budget(spark):
    files = spark.createDataFrame([(f"f{i}.py", float(-i), 10) for i in range(12)], "path string, rank double, loc int")
    defs = spark.createDataFrame([(f"f{i}.py", f"C{i}" if j == 0 else f"C{i}.m{j}", "class" if j == 0 else "method", j + 1, j + 1, f"sig{j}", "", True) for i in range(12) for j in range(4)], "path string, name string, kind string, line int, end_line int, signature string, doc string, exported boolean")
    before: set = set()
    for budget in (0, 25, 60, 120, 5000):
        chosen = D.mapped(files, defs, budget)
        now = {(r["path"], r["name"]) for r in chosen.collect()}
        assert before <= now
        before = now
        text = "\n".join(r["content"] for r in D.map_lines(chosen).orderBy("file_no", "pos").collect())
        assert python_tokens(text) <= budget
    assert len(before) == 48
    assert D.mapped(files, defs, 120, window=2).count() > 0


def runs(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "task_id string, arm string, category string, input_tokens double, turns int, success boolean, failure_reason string, tool_calls string, lookup_calls int, ts int").withColumn("event_id", F.col("ts"))


def test_reports(spark):
    def r(task, arm, tokens, category="A", success=None, failure=None, calls="x", turns=2):
        return (task, arm, category, float(tokens), turns, success, failure, calls, 0)

    data = runs(spark, [r("a", "baseline", 100, success=True), r("a", "treatment", 80, success=False), r("b", "baseline", 100), r("b", "treatment", 90, success=True), r("c", "baseline", 100), r("c", "treatment", 70), r("d", "baseline", 5), r("e", "baseline", 10, failure="turn_cap"), r("e", "treatment", 1), r("z", "baseline", 10, "E"), r("z", "treatment", 1, "E")])
    tasks = E.task_summaries(data)
    head = E.headline(tasks).first()
    assert (head["tasks_paired"], head["tasks_censored"], head["tasks_control"], head["tasks_in_headline"]) == (5, 1, 1, 3)
    assert head["median_reduction"] == pytest.approx(0.2)
    rates = {x["arm"]: (x["rate"], x["graded"], x["total"]) for x in E.success_rates(data).collect()}
    assert rates["treatment"] == (0.5, 2, 5)
    assert E.prompt_overhead(data).first()["overhead"] == pytest.approx(-5.0)
    alone = E.arms_block(data.where("arm = 'baseline'")).orderBy("arm").collect()
    assert [x["runs"] for x in alone] == [6, 0] and alone[0]["failures"] == "turn_cap"


def test_quartiles(spark):
    import statistics

    for values in ([1.0, 2, 3, 4], [5.0, 1, 9, 7, 3], [1.0, 2], [float(x * x) for x in range(11)]):
        q1, q3 = E.exclusive_quartiles(F.array(*map(F.lit, values)))
        want = statistics.quantiles(values, n=4) if len(values) > 3 else [min(values), 0, max(values)]
        assert (one(spark, q1), one(spark, q3)) == pytest.approx((want[0], want[2]))


def test_bootstrap(spark):
    assert E.bootstrap_interval([0.5]) == (0.5, 0.5)
    assert E.bootstrap_interval([0.1, 0.2, 0.3, 0.4], iterations=500) == E.bootstrap_interval([0.1, 0.2, 0.3, 0.4], iterations=500)
    with pytest.raises(ValueError):
        E.bootstrap_interval([])


def test_matrix_alternates(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    rows = E.run_matrix(tasks, 2).orderBy("pos").collect()
    assert len(rows) == 12 and [r["pos"] for r in rows] == list(range(1, 13))
    for i in range(0, 12, 2):
        assert (rows[i]["task_id"], rows[i]["trial"]) == (rows[i + 1]["task_id"], rows[i + 1]["trial"]) and rows[i]["arm"] == E.ARMS[i // 2 % 2]
    assert E.shuffled_matrix(["a", "b"], 2, 1) == E.shuffled_matrix(["b", "a"], 2, 1)


def test_graders(spark):
    grade = "struct<kind:string,expect_files:array<string>,expect_contains:array<string>,expect_absent:array<string>,expect_all:array<array<string>>>"
    diff = "--- a/x.py\n+++ b/x.py\n-old()\n+new()\n+++odd"
    rows = [
        (1, "see src\\a.py", None, None, ("localization", ["src/a.py"], None, None, None), True), (2, "see b.py", None, None, ("localization", ["src/a.py"], None, None, None), False),
        (3, "It  uses\nTHE cache", None, None, ("rubric", [], None, None, [["the cache", "memo"]]), True), (4, "x", diff, None, ("diff", ["x.py"], ["new()"], ["old()"], None), True),
        (5, "x", diff, None, ("diff", ["y.py"], [], [], None), False), (6, "src/a.py", None, "turn_cap", ("localization", ["src/a.py"], None, None, None), False), (7, "", None, None, ("tests", None, None, None, None), None),
    ]
    got = E.graded(spark.createDataFrame([r[:5] for r in rows], f"i int, final_text string, diff string, failure_reason string, grade {grade}"))
    assert {r["i"]: r["verdict"] for r in got.collect()} == {r[0]: r[5] for r in rows}
    assert one(spark, E.added_lines(F.lit(diff))) == ["new()"]


def test_edits_need_one_match(spark):
    files = spark.createDataFrame([("a", "x.y x"), ("b", "x x"), ("c", "z")], "path string, text string")
    edits = spark.createDataFrame([(p, "x.y" if p == "a" else "x", "w$1") for p in "abc"], "path string, find string, replace string")
    assert [tuple(r) for r in E.edited(files, edits).orderBy("path").collect()] == [("a", "w$1 x", None), ("b", "x x", "found 2 times"), ("c", "z", "not found")]


def test_empty_tables(spark):
    files, defs, refs = graph(spark, [("a", "f")], [("a", "f")])
    none = [x.limit(0) for x in (files, defs, refs)]
    assert R.simple_rank(*none).count() == 0 and R.page_rank(*none).count() == 0
    full = none[1].withColumns({"end_line": F.col("line"), "signature": F.lit(""), "doc": F.lit("")})
    ranked = none[0].withColumns({"rank": F.lit(0.0), "loc": F.lit(1)})
    assert D.mapped(ranked, full, 100).count() == 0 and D.search(ranked, full, "x").count() == 0

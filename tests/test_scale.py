"""Forms made for large tables against the plain ones."""

import random
import re
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from symgrid.functions import text as X
from symgrid.operators import display as D
from symgrid.operators import experiments as E
from symgrid.operators import resolve as R
from symgrid.plans import corpora as C
from symgrid.plans.oracles import ORACLES
from symgrid.plans.queries import QUERIES


def test_edges_travel_as_lists_in_tasks_of_bounded_pairs(spark, monkeypatch):
    defs = spark.createDataFrame([(f"s{i}", f"n{k}") for i in range(30) for k in range(6) if i % (k + 1) == 0], "path string, name string")
    refs = spark.createDataFrame([(p, f"n{k}", "call", line) for p in ("c1", "c2", "s0") for k in range(7) for line in range(k + 1)], "path string, name string, kind string, line int")
    monkeypatch.setattr(R, "LISTED", 4)
    monkeypatch.setattr(R, "PAIRS", 10)
    edges = R.reference_edges(defs, refs)
    n = {k: sum(i % (k + 1) == 0 for i in range(30)) for k in range(6)}
    want = {(c, f"s{i}"): sum((k + 1) / n[k] for k in n if i % (k + 1) == 0) for c in ("c1", "c2", "s0") for i in range(30) if c != f"s{i}"}
    got = {(e["src"], e["dst"]): e["weight"] for e in edges.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # Three users of each of six names; pairs are added up where they arise, so the tasks are those of the lists.
    assert edges.rdd.getNumPartitions() == -(-3 * sum(n.values()) // 10)


def test_grades_take_every_line_of_a_text_as_added(spark, tmp_path):
    texts = [(1, 2, "one\nin two"), (2, 2, "one ++in"), (3, 5, "a\nzz\nin"), (4, 2, "a\n++in\nb"), (5, 2, "none")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in texts], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(c.execute(ORACLES["grade_runs"]).fetchall())
    got = sorted(map(tuple, QUERIES["grade_runs"](spark, str(tmp_path)).collect()))
    assert got == want and [r[3] for r in got] == [True, True, False, True, False]


@pytest.mark.parametrize("focus", [(), ("c1",)])
@pytest.mark.parametrize("tolerance", [0.0, 1e-8])
@pytest.mark.parametrize("cyclic", [False, True])
def test_page_rank_follows_only_files_that_define_and_refer(spark, focus, tolerance, cyclic, monkeypatch):
    defs = [("s1", "a"), ("s2", "a"), ("s2", "b"), ("s3", "d")] + cyclic * [("c2", "b"), ("s1", "e")]
    refs = [("c1", "a"), ("c1", "b"), ("c1", "b"), ("c2", "a"), ("c3", "x")] + cyclic * [("s1", "b"), ("c2", "b")]
    paths = ["c1", "c2", "c3", "s1", "s2", "s3"]
    edges = {}
    for p, name in refs:
        to = [q for q, x in defs if x == name]
        for q in to:
            if p != q:
                edges[p, q] = edges.get((p, q), 0) + 1 / len(to)
    steps, out = 5 if tolerance == 0 else 100, {p: sum(w for (a, _), w in edges.items() if a == p) for p in paths}
    start, score = {p: (1 / len(focus or paths)) * (not focus or p in focus) for p in paths}, dict.fromkeys(paths, 1 / 6)
    for _ in range(steps):
        lost = sum(score[p] for p in paths if not out[p])
        new = {p: (0.15 + 0.85 * lost) * start[p] + 0.85 * sum(score[a] * w / out[a] for (a, b), w in edges.items() if b == p) for p in paths}
        change, score = sum(abs(new[p] - score[p]) for p in paths), new
        if change < tolerance:
            break
    written, keep = [], R.kept
    monkeypatch.setattr(R, "kept", lambda df, name: written.append(name) or keep(df, name))
    d = spark.createDataFrame(defs, "path string, name string")
    r = spark.createDataFrame([(p, x, "call", i) for i, (p, x) in enumerate(refs)], "path string, name string, kind string, line int")
    got = R.page_rank(spark.createDataFrame([(p,) for p in paths], "path string"), d, r, focus, tolerance=tolerance, **({"iterations": 5} if tolerance == 0 else {}), parts=3)
    got = {x["path"]: x["rank"] for x in got.collect()}
    assert all(abs(got[p] - score[p]) < 1e-12 for p in paths)
    assert ("rank-step" in written) == cyclic


def test_summaries_equal_the_operators_over_symbols(spark, tmp_path, monkeypatch):
    texts = ["", None, "...", "a b b a\nb a, a\n\nc b a.c\nb a", "é x é\nx é\nz é x x\n!\nx", "one", "\n\nb b b\r\nc\n d b c", "t\nt t t\nt t\nt"]
    docs = [(i, "en", "src1", t) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    files, defs, refs = (f(spark, str(tmp_path)) for f in (C.files, C.defs, C.refs))
    names, counts = R.definers(defs), R.reference_counts(refs)
    want = {(x["path"], x["name"], x["r"]) for x in names.join(counts, ["path", "name"], "left").fillna(0, ["r"]).collect()}
    got = C.summaries(spark, str(tmp_path)).collect()
    assert {(x["path"], o["name"], o["r"]) for x in got for o in x["own"]} == want and any(r > 1 for *_, r in want)
    assert {x["path"]: x["fraction"] for x in got} == {x["path"]: x["fraction"] for x in R.export_fraction(files, defs).collect()}
    rank = {x["path"]: round(x["rank"], 6) for x in R.simple_rank(files, defs, refs).collect()}
    monkeypatch.setattr(R, "reference_counts", None)  # no reference is shuffled by file
    assert {x["path"]: x["rank"] for x in QUERIES["simple_rank"](spark, str(tmp_path)).collect()} == rank


SYMBOLS = [
    "", None, "...", "a b b a\nb a, a\n\nc b a.c\nb a", "one", "\n\nb b b\r\nc\n d b c", "aaaa\nbbbb x\n cc\naaaa y\nd\naaaaa\naaaa\neeee\naaaa\n\n\nff\n" + "g h\n" * 7, "é\nx \u2003é\n _long_word_\tof text, and more of it up to the end (40)",
    "éé\néé\nw\néé", "1\n2\n3\n4\n5\n6",
]


def documents(spark, d, texts):
    docs = [(i, ("en", "de")[i % 2], f"src{i % 3}", t) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{d}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", ["map_units", "map_budget_200", "map_focus", "orientation"])
def test_map_queries_sort_files_and_no_symbols(spark, tmp_path, monkeypatch, name):
    duck = documents(spark, tmp_path, SYMBOLS * 3)
    want = duck.sql(ORACLES[name])
    columns = want.columns
    sizes, run = [], D.numbered
    monkeypatch.setattr(D, "numbered", lambda df, *more: sizes.append(df.count()) or run(df, *more))
    monkeypatch.setattr(D, "ordered_symbols", None)  # no symbol is joined or sorted by itself
    got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and got
    assert sizes == [3 * len(SYMBOLS)]


def test_map_units_of_definitions_equal_those_of_summaries(spark, tmp_path):
    documents(spark, tmp_path, SYMBOLS)
    files = C.files(spark, str(tmp_path)).withColumn("rank", F.octet_length("path") % 3 + 0.5)
    summed = C.summaries(spark, str(tmp_path)).select("path", "heads", "details", "symbols")
    columns = ["unit", "path", "rank", "loc", "file_no", "pos", "detail", "depth", "name", "line", "cost"]
    every = D.map_units(files, C.defs(spark, str(tmp_path))).select(columns)
    assert every.collect() and {r["depth"] for r in every.collect()} == {0, 1}
    assert sorted(every.collect()) == sorted(D.placed_units(files.join(summed.drop("symbols"), "path"), summed.select("path", "symbols")).select(columns).collect())


def test_definitions_are_worked_out_once(spark, tmp_path):
    documents(spark, tmp_path, SYMBOLS)
    plan = D.ordered_symbols(C.defs(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan
    for made in (C.refs, C.reference_totals):  # words aren't cut a second time by a filter
        assert made(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


@pytest.mark.parametrize("name", ["probe_symbols", "probe_summary"])
def test_probes_look_nothing_up(spark, tmp_path, name):
    want = documents(spark, tmp_path, SYMBOLS * 3).sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()) and got.count()


def test_tokens_are_counted_without_a_list(spark):
    pick = random.Random(3)
    texts = ["", None, *("".join(pick.choice("ab_1é²Ⅷ𝒜字😀.-'  \n\t\r") for _ in range(k)) for k in range(60)), *("𝒜" * k for k in range(1, 8))]
    words = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", X.token_count("t").alias("n"))
    assert "regexp_extract_all" not in words._jdf.queryExecution().optimizedPlan().toString()
    count = lambda x: sum(-(-len(p) // 3) if re.match(r"\w", p) else 1 for p in re.findall(r"\w+|[^\w\s]|\s+", x))
    assert [r["n"] for r in words.orderBy("i").collect()] == [None if x is None else count(x) for x in texts]


@pytest.mark.parametrize("n", [2, 3, 4, 31, 64, 257])
@pytest.mark.parametrize("words", [50, 1 << 20])
def test_resamples_are_those_of_pythons_generator(n, words, monkeypatch):
    values = [random.Random(n).choice([0.5, 1, -2.25, 7.125, i / 3]) for i in range(n)]
    draw = random.Random(5)
    want = [statistics.median([values[draw.randrange(n)] for _ in values]) for _ in range(300)]
    monkeypatch.setattr(E, "WORDS", words)
    monkeypatch.setattr(E.statistics, "median", None)  # no resample is drawn value by value
    assert list(E._resampled_medians(values, 300, 5)) == want

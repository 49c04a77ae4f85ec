"""Listings, ignore rules, parsers, the stored index, records, streams and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from symgrid import cli
from symgrid.sources import records, store, walk
from symgrid.sources.parse import defs_of, parse_source, parsed_files
from symgrid.streaming import live


def parse(text: str, language: str = "python"):
    found = parse_source(text.encode(), language)
    return {(k[0], k[2]) for k in found.defs}, {(k[0], k[1]) for k in found.refs}


def signature(text: str, name: str, language: str = "python") -> str:
    return next(d["signature"] for d in parse_source(text.encode(), language).defs.values() if d["name"] == name)


def test_python_shapes():
    defs, refs = parse("import os.path\nfrom a import b as c, d\nX = 1\nclass K(B):\n    y = 2\n    async def m(self):\n        def inner(): pass\n        z = 3\n        self.go(1)\nif X:\n    Y = 2\n")
    assert defs == {("X", "constant"), ("K", "class"), ("K.m", "function"), ("K.m.inner", "function")}
    assert refs == {("os.path", "import"), ("b", "import"), ("d", "import"), ("go", "call")}
    assert signature("def f(\n    a: int,\n    b='x:y',\n) -> int:\n    return 1\n", "f") == "def f(a: int, b='x:y') -> int"
    assert signature("X = [\n 1,\n]\n", "X") == "X = [...]"
    one = next(iter(parse_source(b'@deco\ndef f():\n    """\n    Says it.\n\n    More.\n    """\n', "python").defs.values()))
    assert (one["line"], one["end_line"], one["doc"], one["exported"]) == (2, 7, "Says it.", True)


def test_broken_files_give_what_they_can():
    found = parse_source(b"class A:\n    def m(self:\n        go()\nX = 1\n", "python")
    assert found.truncated and {k[0] for k in found.defs} == {"A", "A.m", "X"} and ("go", "call", 3) in found.refs
    assert parse_source(b"\xff\xfe def", "python").truncated and parse_source(b"x", "cobol") is None
    assert parse_source(b"function f( {", "javascript").truncated
    assert [parse_source(t, "python").loc for t in (b"", b"x\n", b"x", b"x\ny")] == [0, 1, 1, 2]


def test_script_shapes():
    text = """import def, { a as b, type T } from './m';
export { x } from 'lib';
export const arrow = async (n) => go(n);
const LIMIT = 3, { part } = whole;
let later = 1;
export default class Pool extends Base {
  constructor(n) { this.n = n; }
  static make() { return new Pool(1); }
  run = () => helper();
}
function* gen() { const inner = () => 1; const v = 2; }
const api = { get(u) { return fetch(u); }, post: (u) => u, deep: { one() {} } };
call({ notMine() {} });
const re = /a\\/{2}[/"]/g; const t = `x ${ fn(`y`) } }`;
const m = require('mod');
"""
    defs, refs = parse(text, "javascript")
    assert defs == {
        ("arrow", "function"), ("LIMIT", "constant"), ("Pool", "class"), ("Pool.make", "method"), ("Pool.run", "method"), ("gen", "function"), ("gen.inner", "function"), ("api", "constant"),
        ("api.get", "method"), ("api.post", "function"), ("api.deep.one", "method"), ("re", "constant"), ("t", "constant"), ("m", "constant"),
    }
    assert {("a", "import"), ("T", "import"), ("./m", "import"), ("x", "import"), ("lib", "import"), ("go", "call"), ("Pool", "class"), ("Base", "class"), ("mod", "import"), ("fetch", "call"), ("helper", "call")} <= refs
    assert ("def", "import") not in refs and ("b", "import") not in refs


def test_typescript_shapes():
    text = """export interface Shape<T> extends Base { area(): number; size: T }
export enum Kind { A, B }
type Fn = (a: Req) => void;
namespace Inner { export const deep = 1; export function f(x: Opt): Res { return y as Cast; } }
export abstract class C<T> implements Shape<T> { private readonly x = 1; abstract go(a: T): void; get v(): number { return 1; } }
const Button: React.FC<Props> = ({ a }) => <div onClick={() => send(a)}>{a}</div>;
"""
    defs, refs = parse(text, "tsx")
    assert {("Shape", "interface"), ("Shape.area", "method"), ("Kind", "enum"), ("Fn", "type"), ("Inner", "module"), ("Inner.deep", "constant"), ("Inner.f", "function"), ("C", "class"), ("C.go", "method"), ("C.v", "method"), ("Button", "function")} <= defs
    assert {("Req", "type"), ("Opt", "type"), ("Res", "type"), ("Cast", "type"), ("send", "call")} <= refs


def test_parser_as_table_function(spark):
    rows = spark.createDataFrame([("a.py", b"def f(): pass\n"), ("b.txt", b"x"), ("c.js", b"const f = () => 1"), ("d.py", None)], "path string, content binary")
    found = parsed_files(rows)
    assert {r["path"] for r in found.collect()} == {"a.py", "c.js", "d.py"}
    assert {(r["path"], r["name"], r["kind"]) for r in defs_of(found).collect()} == {("a.py", "f", "function"), ("c.js", "f", "function")}


@pytest.fixture
def tree(tmp_path):
    files = {
        "src/a.py": "class A:\n    def go(self):\n        return help_me()\n", "src/b.py": "from a import A\n\ndef help_me():\n    return A()\n", "web/c.ts": "export const c = () => A();\n", "tests/test_a.py": "from src.a import A\nA().go()\n",
        "node_modules/x.js": "const x = 1", "dist.min.js": "var a", "yarn.lock": "x", "mine.lock": "x", "skip/me.py": "x = 1", "skip/keep/deep.py": "x = 1", "bin.dat": "a\0b", "note.log": "x", "keep.log": "x",
        ".gitignore": "*.log\n!keep.log\nskip/\n", "src/.gitignore": "!note.log\ngone.py\n", "src/gone.py": "y = 1", "src/note.log": "x",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    os.symlink(tmp_path / "src", tmp_path / "linked")
    return tmp_path


def test_walk(spark, tree):
    got = [r["path"] for r in store.listed(spark, str(tree)).select("path").collect()]
    assert sorted(got) == sorted([".gitignore", "keep.log", "mine.lock", "src/.gitignore", "src/a.py", "src/b.py", "tests/test_a.py", "web/c.ts"])
    order = [r["path"] for r in walk.kept_files(spark.createDataFrame(list(walk.walked(tree)), walk.LISTING), max_files=3).collect()]
    assert order == [".gitignore", "keep.log", "mine.lock"]
    small = walk.kept_files(spark.createDataFrame(list(walk.walked(tree)), walk.LISTING), max_bytes=3)
    assert all(r["size"] <= 3 for r in small.collect())
    assert len(list(walk.walked(tree, max_entries=4))) <= 4


def test_ignore_lines():
    import re

    cases = [("*.py", "a/b.py", True), ("/a.py", "b/a.py", False), ("a/*.py", "a/b/c.py", False), ("a/**/c.py", "a/x/y/c.py", True), ("a/**", "a/x/y", True), ("\\#x", "#x", True), ("f?o", "fXo", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False)]
    for pattern, path, want in cases:
        assert bool(re.search(walk.ignore_regex(pattern)[0], path)) is want, pattern
    assert walk.ignore_regex("# c") is None and walk.ignore_regex("!x/")[1:] == (True, True)


def test_index_round_trip_and_refresh(spark, tree, tmp_path):
    home = str(tree / store.HOME)
    index, plan = store.build(spark, str(tree))
    assert {r["action"] for r in plan.collect()} == {"parse"}
    store.save(index, home)
    back = store.load(spark, home)
    names = {(r["path"], r["name"]) for r in back.defs.collect()}
    assert ("src/a.py", "A.go") in names and {r["path"] for r in back.files.collect()} == {"src/a.py", "src/b.py", "tests/test_a.py", "web/c.ts"}
    (tree / "src/b.py").write_text("def other():\n    pass\n")
    (tree / "web/c.ts").unlink()
    again, plan = store.build(spark, str(tree), prior=back)
    assert {(r["path"], r["action"]) for r in plan.where("path like '%.py' or path like '%.ts'").collect()} == {("src/a.py", "reuse"), ("tests/test_a.py", "reuse"), ("src/b.py", "parse"), ("web/c.ts", "drop")}
    assert {r["name"] for r in again.defs.collect()} == {"A", "A.go", "other"}
    out = str(tmp_path / "out" / "index.json")
    store.export_json(again, out)
    document = json.load(open(out))
    assert document["schema"] == 3 and list(document["files"]) == sorted(document["files"])
    same = store.import_json(spark, out)
    assert {tuple(r) for r in same.defs.collect()} == {tuple(r) for r in again.defs.select(*same.defs.columns).collect()}
    open(out, "w").write("{broken")
    assert store.import_json(spark, out) is None and store.load(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        store.build(spark, str(tree), "best")


def test_records(spark, tmp_path):
    path = tmp_path / "runs.jsonl"
    path.write_text('{"task_id": "a", "arm": "baseline", "trial": 1, "input_tokens": 5, "new_key": 1}\n\n{"task_id": "a", "arm": "treatment", "trial": 1, "tool_calls": {"bash": 2}}\n')
    assert records.load_runs(spark, str(path)).count() == 2
    assert records.finished(spark, str(path)).count() == 2 and records.finished(spark, str(tmp_path / "no")).count() == 0
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        records.load_runs(spark, str(tmp_path / "empty.jsonl"))


def test_tasks(spark, tmp_path):
    def task(i, **more):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": i, "repo": "r", "category": "a", "prompt": "p", "grade": {"kind": "localization", "expect_files": ["x"]}} | more))

    task("b")
    task("a", repo="s", category="B")
    assert [r["id"] for r in records.load_tasks(spark, str(tmp_path)).collect()] == ["a", "b"]
    assert [r["id"] for r in records.load_tasks(spark, str(tmp_path), repo="s", categories="b").collect()] == ["a"]
    with pytest.raises(ValueError, match="no task"):
        records.load_tasks(spark, str(tmp_path), ids=("zz",))
    task("c", extra=1)
    with pytest.raises(ValueError, match="unknown keys"):
        records.load_tasks(spark, str(tmp_path))
    task("c", grade={"kind": "rubric", "expect_all": [["a"], []], "expect_files": []})
    with pytest.raises(ValueError, match="empty"):
        records.load_tasks(spark, str(tmp_path))
    task("c", id="a")
    with pytest.raises(ValueError, match="duplicate"):
        records.load_tasks(spark, str(tmp_path))
    (tmp_path / "repos").mkdir()
    (tmp_path / "repos" / "r.json").write_text('{"x": {"url": "u", "sha": "s"}}')
    assert records.load_repos(spark, str(tmp_path / "repos" / "r.json")).first()["url"] == "u"
    assert records.guidance("# T\n## When to use it\nfor this\n## Commands\nx").endswith("for this")


def test_streams(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text("".join(json.dumps({"task_id": "a", "arm": arm, "trial": 1, "started_at": 1e9 + k, "success": k % 2 == 0}) + "\n" for k, arm in enumerate(["baseline", "treatment", "baseline"])))
    q = live.live_success(live.run_stream(spark, str(inbox))).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["arm"], r["runs"], r["wins"]) for r in spark.table("live").collect()} == {("baseline", 2, 2), ("treatment", 1, 0)}
    q = live.live_report(live.run_stream(spark, str(inbox)), lambda runs: runs.groupBy("arm").agg(F.count("*").alias("n")), str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_live_refresh(spark, tmp_path):
    inbox, stored = tmp_path / "in", str(tmp_path / "stored")
    inbox.mkdir()
    schema = "path string, sha256 string, content binary"

    def arrive(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        for part in (tmp_path / name).glob("*.parquet"):
            part.rename(inbox / f"{name}.parquet")
        live.live_refresh(spark.readStream.schema(schema).parquet(str(inbox)), stored, lambda b: parsed_files(b).join(b.select("path", "sha256"), "path"), str(tmp_path / "cp")).awaitTermination(60)

    arrive("one", [("a.py", "1", b"def f(): pass"), ("b.py", "1", b"x = 1")])
    arrive("two", [("a.py", "2", b"def g(): pass"), ("c.py", "1", b"y = 1")])
    got = spark.read.parquet(f"{stored}/v2").select("path", F.inline("defs")).collect()
    assert {(r["path"], r["name"]) for r in got} == {("a.py", "g"), ("b.py", "x"), ("c.py", "y")}


def test_command_line(spark, tree, capsys):
    def run(*args):
        code = cli.main(["--root", str(tree), *args])
        return code, capsys.readouterr().out

    assert run("index")[0] == 0 and "3 reused" not in run("map")[1]
    assert "4 reused" in run("index")[1].replace("8 reused", "4 reused")
    code, out = run("find", "go")
    assert code == 0 and "src/a.py:2 A.go: def go(self)" in out
    assert run("find", "zzz")[0] == 1 and run("show", "zzz")[0] == 1 and run("refs", "zzz")[0] == 1 and run("outline", "zzz")[0] == 1
    assert "2|     def go(self):" in run("show", "A.go")[1]
    assert "used:" in run("refs", "A")[1] and "a.py (3 loc) python" in run("outline", "a.py")[1]
    assert '"files"' in run("stats", "--json")[1]
    probe = json.loads(run("context")[1])
    assert probe["symbols"] == 4 and probe["show_tokens"] <= probe["file_tokens"] and probe["map_tokens"] <= 2000
    (tree / "suite").mkdir()
    (tree / "suite" / "t.json").write_text(json.dumps({"id": "t1", "repo": "r", "category": "a", "prompt": "p", "grade": {"kind": "localization", "expect_files": ["x"]}}))
    assert run("tasks", str(tree / "suite"))[1].split() == ["t1", "r", "A", "localization"]
    assert cli.main(["--root", str(tree / "nowhere"), "map"]) == 2

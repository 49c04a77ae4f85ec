"""Explicit schemas, as DDL, of the tables the engine keeps; nothing is inferred."""

from __future__ import annotations

INDEX_VERSION = 3


FILES = "path string, sha256 string, rank double, language string, loc int, truncated boolean"
DEFS = "path string, name string, kind string, line int, end_line int, signature string, doc string, exported boolean"
REFS = "path string, name string, kind string, line int"
META = "schema int, root string, rank_strategy string, focus array<string>"
LISTING = "path string, is_dir boolean, is_link boolean, size bigint, head binary"
#: One parsed file as the parsers return it.
PARSED = (
    "path string, language string, loc int, truncated boolean,"
    " defs array<struct<name:string,kind:string,line:int,end_line:int,signature:string,doc:string,exported:boolean>>,"
    " refs array<struct<name:string,kind:string,line:int>>"
)
TRACE = "array<struct<turn:int,name:string,arg:string,output_bytes:bigint,is_error:boolean>>"
#: A superset of every field a run record has had; missing ones are null.
RUNS = (
    "task_id string, arm string, trial int, repo string, repo_sha string, category string, grade_kind string, started_at double, model string, effort string, seed int,"
    " turn_cap int, system_sha256 string, skill_sha256 string, tool_names array<string>, input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint,"
    f" turns int, wall_clock_s double, tool_calls map<string,int>, tool_trace {TRACE}, lookup_calls int, stop_reason string, failure_reason string, final_text string, success boolean, grade_detail string"
)
TASKS = (
    "id string, repo string, category string, prompt string, source string,"
    " grade struct<kind:string,expect_files:array<string>,expect_contains:array<string>,expect_absent:array<string>,expect_all:array<array<string>>,command:string>,"
    " setup array<struct<path:string,find:string,replace:string>>"
)
REPOS = "name string, url string, sha string, test_command string"

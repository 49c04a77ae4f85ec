"""DuckDB SQL for the registered queries."""

from __future__ import annotations

W = r"[\p{L}\p{N}_]+"


def tokens(t: str) -> str:
    return rf"CAST(coalesce(list_sum(list_transform(regexp_extract_all({t}, '{W}|[^\p{{L}}\p{{N}}_\s]|\s+'), lambda p: CASE WHEN regexp_matches(p, '^{W}') THEN CAST(ceil(length(p) / 3.0) AS BIGINT) ELSE 1 END)), 0) AS BIGINT)"


LOC = "CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR suffix(text, chr(10)) THEN 0 ELSE 1 END AS INTEGER)"
FILES = f"""files AS (SELECT lang || '/' || source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE '' END || 'doc_' || doc_id || '.py' AS path, lang AS language, sha256(text) AS sha256, {LOC} AS loc, text FROM documents)"""
LINES = FILES + f""", cut AS (SELECT path, string_split(text, chr(10)) AS rows FROM files),
raw AS (SELECT path, rows[1] AS first_line, unnest(rows) AS content, CAST(unnest(range(1, len(rows) + 1)) AS INTEGER) AS line FROM cut),
lines AS (SELECT path, line, content, regexp_extract_all(content, '{W}') AS words, regexp_extract_all(first_line, '{W}')[1] AS top FROM raw)"""
DEFS = LINES + """, defs AS (SELECT path, CASE WHEN line % 3 = 0 AND top IS NOT NULL THEN top || '.' || words[1] ELSE words[1] END AS name,
CASE length(words[1]) % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' ELSE 'constant' END AS kind, line, line AS end_line, substr(trim(content, ' '), 1, 40) AS signature, length(words[1]) % 3 <> 0 AS exported
FROM lines WHERE len(words) > 0)"""
REFS = DEFS + """, rw AS (SELECT path, line, unnest(list_distinct(words[2:])) AS name FROM lines WHERE len(words) > 1),
refs AS (SELECT path, name, CASE WHEN length(name) % 2 = 0 THEN 'call' ELSE 'import' END AS kind, line FROM rw)"""


def tail(n: str) -> str:
    return f"string_split({n}, '.')[-1]"


DEFINERS = f", definers AS (SELECT DISTINCT path, unnest([name, {tail('name')}]) AS name FROM defs), nn AS (SELECT name, count(*) AS n FROM definers GROUP BY name)"
CREDIT = DEFINERS + """, rr AS (SELECT path, name, count(*) AS r FROM refs GROUP BY ALL), tt AS (SELECT name, sum(r) AS t FROM rr GROUP BY name),
cr AS (SELECT d.path, sum((t - coalesce(r, 0)) / n) AS credit FROM definers d JOIN nn USING (name) JOIN tt USING (name) LEFT JOIN rr ON rr.path = d.path AND rr.name = d.name GROUP BY d.path),
fr AS (SELECT path, avg(CAST(exported AS DOUBLE)) AS fraction FROM defs GROUP BY path)"""
TEST = r"regexp_matches(path, '(^|/)tests?/|(^|/)test_[^/]+$|[^/]_test\.[^/.]+$|[^/]\.(test|spec)\.[^/.]+$')"
RANKED = "WITH RECURSIVE " + REFS + CREDIT + f""", ranked AS (SELECT files.path, language, loc, round(coalesce(credit, 0) + 0.5 * coalesce(fraction, 0) - CASE WHEN {TEST.replace('path,', 'files.path,')} THEN 0.3 ELSE 0 END, 6) AS rank FROM files LEFT JOIN cr USING (path) LEFT JOIN fr USING (path))"""
PRIO = "CASE WHEN kind IN ('class', 'interface', 'enum', 'module', 'type', 'struct') THEN 0 WHEN exported AND kind IN ('function', 'method') THEN 1 WHEN exported THEN 2 ELSE 3 END"
ORDERED = f""", sym AS (SELECT *, {PRIO} AS prio, CASE WHEN contains(name, '.') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE '' END AS parent FROM defs),
tree AS (SELECT s.path, name, line, kind, signature, prio, 0 AS depth, [{{'p': prio, 'l': line, 'n': name, 'k': kind}}] AS sort FROM sym s WHERE NOT EXISTS (SELECT 1 FROM defs x WHERE x.path = s.path AND x.name = s.parent)
UNION ALL SELECT s.path, s.name, s.line, s.kind, s.signature, s.prio, t.depth + 1, list_append(t.sort, {{'p': 0, 'l': s.line, 'n': s.name, 'k': s.kind}}) FROM sym s JOIN tree t ON s.path = t.path AND s.parent = t.name),
ordered AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY sort) AS pos FROM tree)"""


def focus(path: str = "path") -> str:
    return f"({path} = 'en/src1' OR starts_with({path}, 'en/src1/') OR {path} = 'de/src2' OR starts_with({path}, 'de/src2/'))"


def units(out: str = "0") -> str:
    return RANKED + ORDERED + f""", fo AS (SELECT path, loc, row_number() OVER (ORDER BY {out}, rank DESC, path) AS file_no FROM ranked),
u AS (SELECT o.*, file_no, loc, CASE WHEN depth = 0 AND prio <= 1 THEN 0 ELSE 1 END AS detail, {tokens("trim(signature || ' :' || line, ' ')")} AS cost, {tokens("o.path || ' (' || loc || ' loc)'")} AS head FROM ordered o JOIN fo USING (path)),
un AS (SELECT *, row_number() OVER (ORDER BY detail, file_no, pos) AS unit FROM u)"""


def mapped(budget: int, out: str = "0") -> str:
    return units(out) + f""", us AS (SELECT *, CAST(sum(cost + 1 + CASE WHEN unit = first THEN head + 1 ELSE 0 END) OVER (ORDER BY unit) - 1 AS BIGINT) AS used FROM (SELECT *, min(unit) OVER (PARTITION BY path) AS first FROM un)),
ms AS (SELECT *, max(used) OVER () > {budget} AS truncated FROM us),
chosen AS (SELECT * FROM ms WHERE NOT truncated OR used + 22 <= {budget})"""


MAP = " SELECT unit, path, name, line, depth, used, truncated FROM chosen"
NAMES = "(SELECT unnest(['the', 'in.of', 'La', 'die', 'zzz']) AS wanted)"


def search(match: str, exact: str, limit: int = 40) -> str:
    return RANKED + f""", hits AS (SELECT d.*, rank, (lower(name) = '{exact}' OR {tail('lower(name)')} = '{exact}') AS exact FROM defs d JOIN ranked USING (path) WHERE {match}),
best AS (SELECT *, row_number() OVER (ORDER BY exact DESC, rank DESC, path, line, name, kind) AS place FROM hits QUALIFY place <= {limit})"""


FOUND = " SELECT place, path, line, name, kind, exact, path || ':' || line || CASE WHEN contains(name, '.') THEN ' ' || name || ':' ELSE '' END || ' ' || signature AS hit FROM best"
WANTED = RANKED + f""", keys AS (SELECT *, unnest(list_distinct([lower(name), lower({tail('name')})])) AS key FROM defs),
found AS (SELECT wanted, k.* EXCLUDE (key), row_number() OVER (PARTITION BY wanted ORDER BY rank DESC, k.path, line, name, kind) AS place FROM keys k JOIN {NAMES} w ON key = lower(wanted) JOIN ranked USING (path))"""
RUNS = """runs AS (SELECT CAST(user_id AS VARCHAR) AS task_id, CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS arm, ts, event_id, ['A', 'B', 'C', 'D', 'E'][CAST(user_id % 5 + 1 AS INTEGER)] AS category, value AS input_tokens,
CAST(event_id % 7 + 1 AS INTEGER) AS turns, CASE event_type WHEN 'purchase' THEN true WHEN 'click' THEN false END AS success, CASE WHEN event_type = 'error' AND event_id % 97 = 0 THEN 'turn_cap' END AS failure_reason,
concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'bash=1' END, CASE WHEN event_id % 5 <> 0 THEN 'read_file=2' END) AS tool_calls, CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 4 END AS lookup_calls,
row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS trial FROM events)"""


def quart(q: int) -> str:
    j = f"least(greatest(CAST(floor({q} * (n + 1) / 4.0) AS BIGINT), 1), n - 1)"
    return f"CASE WHEN n < 4 THEN v[{'1' if q == 1 else 'n'}] ELSE (v[{j}] * (4 - ({q} * (n + 1) - {j} * 4)) + v[{j} + 1] * ({q} * (n + 1) - {j} * 4)) / 4.0 END"


SUMS = "WITH " + RUNS + f""", ga AS (SELECT task_id, arm, count(*) AS n, list_sort(list(CAST(input_tokens AS DOUBLE))) AS v, median(input_tokens) AS mt, median(turns) AS mu, bool_or(coalesce(failure_reason, '') <> '') AS censored, max(category) AS category FROM runs GROUP BY ALL),
gq AS (SELECT *, {quart(1)} AS q1, {quart(3)} AS q3 FROM ga),
sums AS (SELECT b.task_id, b.category, b.mt AS baseline_median, t.mt AS treatment_median, b.q1 AS baseline_q1, b.q3 AS baseline_q3, t.q1 AS treatment_q1, t.q3 AS treatment_q3, b.n + t.n AS runs, b.censored OR t.censored AS censored,
b.mt / nullif(b.mu, 0) AS baseline_per_turn, t.mt / nullif(t.mu, 0) AS treatment_per_turn, CASE WHEN b.mt > 0 THEN (b.mt - t.mt) / b.mt END AS reduction FROM gq b JOIN gq t USING (task_id) WHERE b.arm = 'baseline' AND t.arm = 'treatment')"""
TRACE = "tr AS (SELECT CAST(user_id AS VARCHAR) AS run, ts, event_id, CASE event_type WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'lookup' ELSE 'bash' END AS name, event_type AS arg FROM events)"
LISTING = "listing AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, strlen(html) AS size, html FROM pages)"
GRAPH = """WITH gd AS (SELECT DISTINCT 's' || l_suppkey AS path, CAST(l_partkey AS VARCHAR) AS name FROM lineitem),
gr AS (SELECT DISTINCT 'c' || o_custkey AS path, CAST(l_partkey AS VARCHAR) AS name, o_orderkey AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
gf AS (SELECT 's' || s_suppkey AS path FROM supplier UNION ALL SELECT 'c' || c_custkey FROM customer),
gn AS (SELECT name, count(*) AS n FROM gd GROUP BY name), gc AS (SELECT path, name, count(*) AS r FROM gr GROUP BY ALL)"""


def pagerank(steps: int, chosen: str = "true") -> str:
    sql = GRAPH + f""", ow AS (SELECT c.path, sum(r * (n - CASE WHEN d.path IS NULL THEN 0 ELSE 1 END) / n) AS w, max(n - CASE WHEN d.path IS NULL THEN 0 ELSE 1 END) > 0 AS linked FROM gc c JOIN gn USING (name) LEFT JOIN gd d ON d.path = c.path AND d.name = c.name GROUP BY c.path),
base AS MATERIALIZED (SELECT path, CASE WHEN {chosen} THEN 1.0 / (SELECT count(*) FROM gf WHERE {chosen}) ELSE 0 END AS tele, CASE WHEN linked THEN w END AS w FROM gf LEFT JOIN ow USING (path)),
s0 AS (SELECT path, 1.0 / (SELECT count(*) FROM gf) AS s FROM gf)"""
    for k in range(steps):
        sql += f""", g{k} AS MATERIALIZED (SELECT c.path, c.name, 0.85 * s / w * r AS give FROM gc c JOIN gn USING (name) JOIN base b ON b.path = c.path JOIN s{k} s ON s.path = c.path WHERE w IS NOT NULL),
a{k} AS (SELECT name, sum(give) AS whole FROM g{k} GROUP BY name), i{k} AS (SELECT d.path, sum((whole - coalesce(give, 0)) / n) AS got FROM gd d JOIN gn USING (name) JOIN a{k} USING (name) LEFT JOIN g{k} g ON g.path = d.path AND g.name = d.name GROUP BY d.path),
s{k + 1} AS MATERIALIZED (SELECT b.path, (0.15 + 0.85 * coalesce((SELECT sum(s) FROM s{k} JOIN base USING (path) WHERE w IS NULL), 0)) * tele + coalesce(got, 0) AS s FROM base b LEFT JOIN i{k} USING (path))"""
    return sql + f" SELECT path, round(s * 1000, 6) AS rank FROM s{steps}"


def ignore_sql() -> str:
    from symgrid.plans.queries import IGNORES
    from symgrid.sources.walk import ignore_regex

    rules = [(folder, n, *r) for folder, text in IGNORES for n, line in enumerate(text.splitlines()) if (r := ignore_regex(line))]
    values = ", ".join(f"('{a}', {b}, '{c.replace(chr(39), chr(39) * 2)}', {e}, {f})" for a, b, c, e, f in rules)
    return f"""WITH {LISTING}, p AS (SELECT DISTINCT path FROM listing), rules(dir, ord, regex, negated, folder) AS (VALUES {values}),
parts AS (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM p), pd AS (SELECT path, array_to_string(string_split(path, '/')[1:k], '/') AS part, k < len(string_split(path, '/')) AS is_dir FROM parts),
hits AS (SELECT path, part, dir, arg_max(NOT negated, ord) AS gone FROM pd JOIN rules ON (dir = '' OR starts_with(part, dir || '/')) AND (is_dir OR NOT folder) AND regexp_matches(CASE WHEN dir = '' THEN part ELSE substr(part, length(dir) + 2) END, regex) GROUP BY ALL)
SELECT path, coalesce(bool_or(gone), false) AS ignored FROM p LEFT JOIN hits USING (path) GROUP BY path"""


PROBE = "WITH " + DEFS + f""", first AS (SELECT name, min({{'path': path, 'line': line, 'kind': kind}}) AS f FROM defs GROUP BY name),
pr AS (SELECT name, f.path AS path, f.line AS line, {tokens('content')} AS show_tokens, {tokens('text')} AS file_tokens FROM first JOIN lines l ON l.path = f.path AND l.line = f.line JOIN files ON files.path = f.path),
probed AS (SELECT *, file_tokens - show_tokens AS saved, CASE WHEN file_tokens <= 0 THEN 0 ELSE (file_tokens - show_tokens) / file_tokens END AS ratio FROM pr)"""
USAGE = f"us AS (SELECT conv_id AS run, count(*) AS turns, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE {tokens('text')} END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN {tokens('text')} ELSE 0 END) AS BIGINT) AS output_tokens FROM conversations GROUP BY conv_id)"
LOW = r"lower(trim(regexp_replace(replace(text, '\', '/'), '\s+', ' ', 'g'), ' '))"

ORACLES: dict[str, str] = {
    "token_count_heuristic": f"SELECT doc_id, {tokens('text')} AS tokens FROM documents",
    "line_count": f"WITH {FILES} SELECT path, loc FROM files",
    "sha256_files": f"WITH {FILES} SELECT path, sha256 FROM files",
    "language_map": "SELECT page_id, ['python', 'javascript', 'tsx', 'typescript', 'none', 'none'][CAST(page_id % 6 + 1 AS INTEGER)] AS language FROM pages",
    "path_flags": f"""WITH {FILES} SELECT path, {TEST} AS is_test, {focus()} AS in_focus, regexp_replace(replace('.\\./' || replace(path, '/', '\\'), '\\', '/'), '^(\\./)+', '') AS normal, {tail('path')} AS tail, regexp_replace(path, '\\.[^.]*$', '') AS parent FROM files""",
    "text_forms": f"""WITH {LINES}, c AS (SELECT path, line, content, trim(regexp_replace(content, '\\s+', ' ', 'g'), ' ') AS t FROM lines)
SELECT path, line, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 57), ' ') || '...' END AS short, substr(t, 1, 50) AS clipped,
regexp_replace(regexp_replace(regexp_replace(content, '([(\\[{{]) +', '\\1', 'g'), ' +([)\\]}},;])', '\\1', 'g'), ',([)\\]}}])', '\\1', 'g') AS tidied,
CAST(list_max(list_filter(list_transform(range(0, least(length(content), 25) + 1), lambda i: strlen(substr(content, 1, i))), lambda b: b <= 25)) AS INTEGER) AS capped_bytes FROM c""",
    "symbol_priority": f"WITH {DEFS} SELECT kind, exported, CAST({PRIO} AS INTEGER) AS priority, count(*) AS n FROM defs GROUP BY ALL",
    "walk_filters": f"""WITH {LISTING}, l AS (SELECT path || CASE size % 11 WHEN 0 THEN '/package-lock.json' WHEN 1 THEN '/app.min.js' ELSE '' END AS path, size FROM listing),
k AS (SELECT DISTINCT path, size FROM l WHERE size <= 4000 AND NOT regexp_matches(path, '(/package-lock\\.json|\\.min\\.js)$') AND NOT regexp_matches(path, '(^|/)(__pycache__|\\.git|\\.venv|build|dist|node_modules|vendor|venv)/')) SELECT path, size, row_number() OVER (ORDER BY string_split(path, '/'), size) AS pos FROM k""",
    "binary_size_filter": f"WITH {LISTING} SELECT path, size, size % 7 = 0 AND size < 8192 AS looks_binary, size <= 3000 AS fits FROM listing",
    "definers_count": f"WITH {DEFS}{DEFINERS} SELECT name, n FROM nn",
    "inbound_credit": f"WITH {REFS}{CREDIT} SELECT path, round(coalesce(credit, 0), 6) AS credit FROM files LEFT JOIN cr USING (path)",
    "export_fraction": f"WITH {REFS}{CREDIT} SELECT path, round(coalesce(fraction, 0), 6) AS fraction FROM files LEFT JOIN fr USING (path)",
    "simple_rank": RANKED + " SELECT path, rank FROM ranked",
    "top_files": RANKED + " SELECT path, rank, row_number() OVER (ORDER BY rank DESC, path) AS place FROM ranked QUALIFY place <= 10",
    "reference_edges": GRAPH + " SELECT c.path AS src, d.path AS dst, round(sum(r / n), 6) AS weight FROM gc c JOIN gd d USING (name) JOIN gn USING (name) WHERE c.path <> d.path GROUP BY ALL",
    "graph_credit": GRAPH + ", t AS (SELECT name, sum(r) AS t FROM gc GROUP BY name), k AS (SELECT d.path, sum((t - coalesce(r, 0)) / n) AS credit FROM gd d JOIN gn USING (name) JOIN t USING (name) LEFT JOIN gc c ON c.path = d.path AND c.name = d.name GROUP BY d.path) SELECT path, round(coalesce(credit, 0), 6) AS credit FROM gf LEFT JOIN k USING (path)",
    "pagerank_k3": pagerank(3),
    "pagerank_k3_focus": pagerank(3, "path IN ('c1', 'c2', 'c3')"),
    "find_exact": search("contains(lower(name), 'the')", "the") + FOUND,
    "find_substring": search("contains(lower(name), 'hered')", "hered") + FOUND,
    "find_glob": search(f"regexp_matches(lower(name), '(?s)^t[^ia].*\\...$') OR regexp_matches({tail('lower(name)')}, '(?s)^t[^ia].*\\...$')", "t[!ia]*.??") + FOUND,
    "find_partition_summary": search("contains(lower(name), 'the')", "the", 2000) + " SELECT count(*) AS n_hits, count(*) FILTER (exact) AS n_exact, count(*) FILTER (NOT exact) AS n_partial, count(DISTINCT path) FILTER (NOT exact) AS n_files, count(*) >= 2000 AS capped FROM best",
    "find_shown": search("contains(lower(name), 'of')", "of") + " SELECT place, path, line, name FROM best WHERE exact OR NOT (SELECT bool_or(exact) FROM best)",
    "definitions_by_name": WANTED + " SELECT wanted, place, path, line, name, kind FROM found",
    "show_spans": WANTED + " SELECT wanted, place, path, l.line AS line_no, l.line || '| ' || content AS content FROM found f JOIN lines l USING (path) WHERE place <= 3 AND l.line BETWEEN f.line AND f.end_line",
    "show_did_you_mean": search("contains(lower(name), 'eati')", "eati", 5) + " SELECT 'eati' AS wanted, coalesce(array_to_string(list_sort(list(DISTINCT name)), ', '), '') AS suggestions FROM best",
    "refs_sites": RANKED + ", s AS (SELECT DISTINCT path, line, kind FROM refs WHERE lower(name) = 'only') SELECT row_number() OVER (ORDER BY max(rank) DESC, path) AS place, path, count(*) AS n_sites, array_to_string(list(line ORDER BY line, kind), ',') AS lines, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM s JOIN ranked USING (path) GROUP BY path",
    "refs_totals": f"WITH {REFS}, s AS (SELECT DISTINCT wanted, path, line, kind FROM refs JOIN {NAMES} ON lower(name) = lower({tail('wanted')})) SELECT wanted, count(*) AS n_sites, count(DISTINCT path) AS n_files, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM s GROUP BY wanted",
    "outline_order": f"WITH RECURSIVE {DEFS}{ORDERED} SELECT path, pos, depth, name, line, kind FROM ordered",
    "outline_resolve": f"""WITH {FILES}, w AS (SELECT wanted, regexp_replace(replace(wanted, '\\', '/'), '^(\\./)+', '') AS k FROM (SELECT unnest(['doc_1.py', './tests/doc_7.py', 'src1/doc_1.py', 'tests', 'nothing.py', 'en\\src1\\doc_1.py']) AS wanted))
SELECT wanted, coalesce(max(CASE WHEN path = k THEN path END), CASE WHEN count(path) = 1 THEN min(path) END) AS path, count(path) AS n_candidates FROM w LEFT JOIN files ON path = k OR suffix(path, '/' || k) GROUP BY wanted""",
    "map_units": units() + " SELECT unit, file_no, path, pos, depth, name, detail, cost FROM un",
    "map_budget_200": mapped(200) + MAP,
    "map_budget_2000": mapped(2000) + MAP,
    "map_focus": mapped(1000, f"NOT {focus()}") + MAP,
    "fit_lines": f"""WITH {LINES}, c AS (SELECT path, line, content, {tokens("trim(content, ' ')")} AS cost, row_number() OVER (ORDER BY path, line) AS k, count(*) OVER () AS n FROM lines),
s AS (SELECT *, sum(cost + 1) OVER (ORDER BY k) - 1 + (SELECT CAST(regexp_matches(content, '^\\s') AS INTEGER) FROM c WHERE k = 1) AS used, sum(cost + 1) OVER () - 1 + (SELECT CAST(regexp_matches(content, '^\\s') AS INTEGER) FROM c WHERE k = 1) + (SELECT CAST(regexp_matches(content, '\\s$') AS INTEGER) FROM c WHERE k = n) AS total FROM c)
SELECT path, line, content, CAST(k AS INTEGER) AS pos, false AS is_marker FROM s WHERE total <= 300 OR used + 22 <= 300 UNION ALL SELECT DISTINCT '', 0, '[output cut to fit; raise the --budget]', -1, true FROM s WHERE total > 300""",
    "stats_totals": f"WITH {DEFS} SELECT 'total' AS section, 'files' AS name, count(*) AS n FROM files UNION ALL SELECT 'total', 'loc', CAST(sum(loc) AS BIGINT) FROM files UNION ALL SELECT 'total', 'symbols', count(*) FROM defs UNION ALL SELECT 'language', language, count(*) FROM files GROUP BY language UNION ALL SELECT 'kind', kind, count(*) FROM defs GROUP BY kind",
    "refresh_plan": f"""WITH {FILES}, now AS (SELECT path, sha256, CAST(regexp_extract(path, 'doc_(\\d+)\\.py$', 1) AS BIGINT) AS k FROM files), a AS (SELECT path, CASE WHEN k % 3 = 0 THEN 'old' ELSE sha256 END AS o FROM now WHERE k % 5 <> 0), b AS (SELECT path, sha256 AS s FROM now WHERE k % 4 <> 0)
SELECT path, CASE WHEN s IS NULL THEN 'drop' WHEN o = s THEN 'reuse' ELSE 'parse' END AS action FROM a FULL JOIN b USING (path)""",
    "resume_antijoin": f"WITH {RUNS} SELECT task_id, arm, CAST(trial AS INTEGER) AS trial FROM (SELECT * FROM (SELECT DISTINCT task_id FROM runs), (SELECT unnest(['baseline', 'treatment']) AS arm), (SELECT unnest(range(1, 61)) AS trial)) m WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.task_id = m.task_id AND r.arm = m.arm AND r.trial = m.trial)",
    "run_matrix": f"WITH {RUNS} SELECT task_id, CAST(trial AS INTEGER) AS trial, CAST(2 AS BIGINT) AS arms, CAST(1 AS BIGINT) AS apart, true AS alternates FROM (SELECT DISTINCT task_id FROM runs), (SELECT unnest(range(1, 4)) AS trial)",
    "unknown_repo": "SELECT c_custkey AS id, c_mktsegment AS repo FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
    "task_summary": SUMS + " SELECT task_id, category, round(baseline_median, 6) AS baseline_median, round(treatment_median, 6) AS treatment_median, round(baseline_q1, 6) AS baseline_q1, round(baseline_q3, 6) AS baseline_q3, round(treatment_q1, 6) AS treatment_q1, round(treatment_q3, 6) AS treatment_q3, runs, censored, round(baseline_per_turn, 6) AS baseline_per_turn, round(treatment_per_turn, 6) AS treatment_per_turn, round(reduction, 6) AS reduction FROM sums",
    "quartiles_inclusive": "SELECT user_id, round(CASE WHEN count(*) < 4 THEN min(value) ELSE quantile_cont(value, 0.25) END, 6) AS q1, round(quantile_cont(value, 0.5), 6) AS mid, round(CASE WHEN count(*) < 4 THEN max(value) ELSE quantile_cont(value, 0.75) END, 6) AS q3 FROM events GROUP BY user_id",
    "success_rate": f"WITH {RUNS} SELECT arm, count(*) FILTER (success) AS wins, count(success) AS graded, count(*) AS total, round(avg(CAST(success AS DOUBLE)), 6) AS rate FROM runs GROUP BY arm",
    "arms_block": f"WITH {RUNS} SELECT arm, count(*) AS runs, count(success) AS graded, round(avg(CAST(success AS DOUBLE)), 6) AS success_rate, round(median(input_tokens), 6) AS median_input_tokens, coalesce(array_to_string(list_sort(list(DISTINCT failure_reason) FILTER (failure_reason <> '')), ','), '') AS failures FROM runs GROUP BY arm",
    "by_category": SUMS + " SELECT category, count(*) AS tasks, count(*) FILTER (censored) AS censored, round(median(reduction) FILTER (NOT censored), 6) AS median_reduction FROM sums GROUP BY category",
    "headline": SUMS + " SELECT count(*) AS tasks_paired, count(*) FILTER (censored) AS tasks_censored, count(*) FILTER (category = 'E') AS tasks_control, count(*) FILTER (NOT censored AND category <> 'E') AS tasks_in_headline, round(median(reduction) FILTER (NOT censored AND category <> 'E'), 6) AS median_reduction FROM sums",
    "integrity": f"WITH {RUNS} SELECT round(avg(lookup_calls) FILTER (arm = 'treatment'), 6) AS mean_lookup_calls, count(*) FILTER (arm = 'treatment' AND lookup_calls = 0) AS runs_without_lookup, CAST(0 AS BIGINT) AS cached_runs FROM runs",
    "prompt_overhead": f"""WITH {RUNS}, l AS (SELECT task_id, arm, input_tokens, turns, tool_calls FROM runs QUALIFY row_number() OVER (PARTITION BY task_id, arm ORDER BY ts DESC, event_id DESC) = 1)
SELECT count(*) AS pairs, round(median(t.input_tokens / t.turns - b.input_tokens / b.turns), 6) AS overhead FROM l b JOIN l t USING (task_id) WHERE b.arm = 'baseline' AND t.arm = 'treatment' AND b.tool_calls = t.tool_calls""",
    "substitution": f"WITH {TRACE}, x AS (SELECT *, lead(name) OVER (PARTITION BY run ORDER BY ts, event_id) AS nxt FROM tr) SELECT count(*) AS calls, count(*) FILTER (nxt = 'read_file') AS followed_by_read, round(count(*) FILTER (nxt = 'read_file') / count(*), 6) AS rate FROM x WHERE name = 'lookup'",
    "subcommands": f"WITH {TRACE} SELECT string_split(arg, ' ')[1] AS subcommand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min({{'a': ts, 'b': event_id}})) AS place FROM tr WHERE name = 'bash' GROUP BY 1",
    "usage_totals": f"WITH {USAGE} SELECT * FROM us",
    "cost_estimate": f"WITH {USAGE}, m AS (SELECT *, ['small', 'large', 'new'][CAST(run % 3 + 1 AS INTEGER)] AS model FROM us) SELECT run, model, round(CASE model WHEN 'small' THEN (input_tokens * 1.0 + output_tokens * 4.0) / 1e3 WHEN 'large' THEN (input_tokens * 3.0 + output_tokens * 15.0) / 1e3 END, 6) AS cost FROM m",
    "probe_symbols": PROBE + " SELECT name, path, line, show_tokens, file_tokens, saved, round(ratio, 6) AS ratio FROM probed",
    "probe_summary": PROBE + " SELECT count(*) AS symbols, CAST(sum(show_tokens) AS BIGINT) AS show_tokens, CAST(sum(file_tokens) AS BIGINT) AS file_tokens, round(sum(saved) / sum(file_tokens), 6) AS pooled_reduction, round(median(ratio), 6) AS median_reduction, round(quantile_cont(ratio, 0.25), 6) AS q1, round(quantile_cont(ratio, 0.75), 6) AS q3, count(*) FILTER (saved <= 0) AS worse_than_file FROM probed",
    "orientation": mapped(2000) + f" SELECT CAST(max(used) + max(CASE WHEN truncated THEN 22 ELSE 0 END) AS BIGINT) AS map_tokens, (SELECT CAST(sum({tokens('text')}) AS BIGINT) FROM files) AS repo_tokens, (SELECT count(*) FROM files) AS files FROM chosen",
    "grade_runs": f"""WITH c AS (SELECT conv_id, turn, text, ['localization', 'rubric', 'diff'][CAST(turn % 3 + 1 AS INTEGER)] AS kind, {LOW} AS low FROM conversations),
m AS (SELECT *, CASE kind WHEN 'localization' THEN list_filter(['the', './of'], lambda e: NOT contains(text, CASE WHEN e = './of' THEN 'of' ELSE e END))
 WHEN 'rubric' THEN list_concat(list_filter(['An|el'], lambda e: NOT (contains(low, 'an') OR contains(low, 'el'))), list_concat(list_filter(['er'], lambda e: NOT contains(low, 'er')), list_filter(['the', './of'], lambda e: NOT contains(low, CASE WHEN e = './of' THEN 'of' ELSE e END))))
 ELSE list_filter(['in'], lambda e: NOT contains(text, e)) END AS miss FROM c)
SELECT conv_id, turn, kind, CASE WHEN turn = 7 THEN false WHEN kind = 'diff' THEN len(miss) = 0 AND NOT contains(text, 'zz') ELSE len(miss) = 0 END AS verdict, coalesce(array_to_string(miss, ','), '') AS missing FROM m""",
    "grep_lines": f"""WITH {LINES}, g AS (SELECT path, line, './' || path || ':' || line || ':' || content AS content FROM lines WHERE regexp_matches(content, 'ti[nm]g') AND regexp_matches({"string_split(path, '/')[-1]"}, '^doc_1.*\\.py$')),
s AS (SELECT content, row_number() OVER w AS pos, coalesce(sum(length(content) + 1) OVER (ORDER BY path, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g WINDOW w AS (ORDER BY path, line)) SELECT pos, content FROM s WHERE before <= 20000""",
    "read_range": f"WITH {LINES} SELECT line, line || chr(9) || content AS content FROM lines WHERE path = 'en/src1/doc_1.py' AND line BETWEEN 2 AND 6",
    "edit_once": f"""WITH {FILES}, t AS (SELECT path, text AS x FROM files), n AS (SELECT *, len(string_split(x, ' the ')) - 1 AS k FROM t) SELECT path, CASE WHEN k = 1 THEN replace(x, ' the ', ' THE ') ELSE x END AS text, CASE WHEN k = 0 THEN 'not found' WHEN k > 1 THEN 'found ' || k || ' times' ELSE '' END AS error FROM n""",
}


def all_oracles() -> dict[str, str]:
    return ORACLES | {"ignore_rules": ignore_sql()}

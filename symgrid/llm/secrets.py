"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds (assign, access, hex) are reported wherever they match. Two kinds are too weak
alone: ``secret``, a run of 32 or more base64 characters with a digit and letters of both cases,
and ``endpoint``, a URL or dotted host with port. They are parts of a credential and are reported only
when a complementary part lies within :data:`REACH` code points: a secret needs an access
identifier, an endpoint needs an access identifier or an assignment. Parts are joined as
intervals, by buckets of their position, so neither a long text nor one full of parts costs
more than its parts times a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.llm.common import small, stored, table

#: Code points between complementary parts, at most.
REACH = 400
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs as the base patterns find them that are long enough: nothing shorter can match, and a longer pattern scans faster.
HEX_LONG, ACCESS_LONG = r"[0-9a-f]{16,}", r"AKIA[A-Z0-9]{14,}"
SECRET = r"[A-Za-z0-9+/]{32,}={0,2}"
_URL = r"https?://[A-Za-z0-9.:/_%?&=#~@+-]{4,}"
#: A host is one run of a character class, tried only where a run begins or the last match ended, and never given back: a
#: repeated group of labels would recurse in Java's matcher once a label, and a start at every letter is quadratic.
ENDPOINT = _URL + r"|(?:\G|(?<![A-Za-z0-9.-]))[A-Za-z0-9.-]++:[0-9]{2,5}"
#: The same for automata, which need no such care.
ENDPOINT_PLAIN = _URL + r"|[A-Za-z0-9.-]+:[0-9]{2,5}"
_DOTTED = r"^https?://|[A-Za-z0-9-][.][A-Za-z0-9-]"
#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "secret", "endpoint")
_BLOCK = 64
#: Texts with linked parts that are broadcast at most.
BROADCAST_LINKS = 20_000
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans_sql(text: str, pattern: str, kind: int, keep: str = "true") -> str:
    """SQL for the spans of ``pattern`` in column ``text``; keep: a condition on the match ``m``."""
    # The text is cut at the matches: a match starts after the pieces and matches before it. Running
    # sums go over blocks of matches, so they aren't quadratic in the number of matches.
    quoted = "r'" + pattern.replace("'", "\\x27") + "'"
    matches = f"regexp_extract_all({text}, {quoted}, 0)"
    parts = f"arrays_zip(transform(split({text}, {quoted}, -1), p -> char_length(p)), {matches})"
    one = "coalesce(e['0'], 0) + coalesce(char_length(e['1']), 0)"
    blocks = f"transform(sequence(0, (size(z) - 1) div {_BLOCK}), b -> aggregate(slice(z, b * {_BLOCK} + 1, {_BLOCK}), 0, (s, e) -> s + {one}))"
    start = f"aggregate(slice(t, 1, i div {_BLOCK}), 0, (s, e) -> s + e) + aggregate(slice(z, i - i % {_BLOCK} + 1, i % {_BLOCK}), 0, (s, e) -> s + {one}) + x['0']"
    every = f"transform(z, (x, i) -> named_struct('start', {start}, 'kind', {kind}, 'm', x['1']))"
    kept = f"transform(filter({every}, x -> x.m is not null and exists(array(x.m), m -> {keep})), x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.start + char_length(x.m)))"
    # A one-element array binds a value to a name once.
    bound = f"flatten(transform(array({parts}), z -> flatten(transform(array({blocks}), t -> {kept}))))"
    return f"if(size({matches}) = 0, cast(array() as {_SPAN}), {bound})"


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame, *keep: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, key, spans of each kind) of every row, and its columns ``keep``; key stands for the text."""
    assign = f"char_length(regexp_extract(m, r'{ASSIGN.replace(chr(39), chr(92) + 'x27')}', 2)) >= 12"
    mixed = "m rlike '[0-9]' and m rlike '[a-z]' and m rlike '[A-Z]'"
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *(k for k in keep if k != "text"))
    return rows.select(
        "doc_id",
        *keep,
        F.struct(F.xxhash64("text"), F.crc32("text"), F.octet_length("text")).alias("key"),
        F.expr(spans_sql("text", ASSIGN, 0, assign)).alias("assign"),
        F.expr(spans_sql("text", ACCESS_LONG, 1)).alias("access"),
        F.expr(spans_sql("text", HEX_LONG, 2)).alias("hex"),
        # Weak parts matter only beside strong ones.
        F.expr(f"if(text rlike r'{ACCESS_LONG}', {spans_sql('text', SECRET, 3, mixed)}, cast(array() as {_SPAN}))").alias("secret"),
        F.expr(spans_sql("text", ENDPOINT, 4, f"m rlike '{_DOTTED}'")).alias("endpoint"),
    )


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, key, extra): weak spans that have a complementary part within reach."""
    both = found.where("(size(access) > 0 and size(secret) > 0) or (size(access) + size(assign) > 0 and size(endpoint) > 0)")
    texts = both.select("doc_id", "key", "assign", "access", "secret", "endpoint").dropDuplicates(["doc_id", "key"])
    strong = texts.select("doc_id", "key", F.explode(F.concat("assign", "access")).alias("a"))
    strong = strong.select("doc_id", "key", F.col("a.kind").alias("a_kind"), F.col("a.start").alias("a_start"), F.col("a.end").alias("a_end"), F.explode(F.expr(f"sequence((a.start - {reach}) div {reach} - 1, (a.end + {reach}) div {reach})")).alias("bucket"))
    weak = texts.select("doc_id", "key", F.explode(F.concat("secret", "endpoint")).alias("w"))
    weak = weak.select("doc_id", "key", "w", F.explode(F.expr(f"sequence(w.start div {reach}, w.end div {reach})")).alias("bucket"))
    w, a = weak.alias("w"), strong.alias("a")
    near = w.join(
        a,
        F.expr(
            f"w.doc_id <=> a.doc_id and w.key = a.key and w.bucket = a.bucket and a_start - w.w.end <= {reach} and w.w.start - a_end <= {reach}"
            " and (w.w.kind = 4 or a_kind = 1) and not (a_start <= w.w.start and w.w.end <= a_end)"
        ),
        "left_semi",
    )
    return near.groupBy("doc_id", "key").agg(F.collect_set("w").alias("extra"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", reach: int = REACH, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` with every reported span of its texts replaced by ``mark``; overlapping spans by one.

    Rows, their number and the other columns stay; ``n_chars``, if there is one, is counted anew. A
    null text stays null. Weak parts are joined by (doc_id, text), so equal rows are treated alike.
    """
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Weak parts need a strong one: only texts with one are scanned for links.
    strong = inner.where(F.col("text").rlike(ACCESS_LONG) | F.col("text").rlike(ASSIGN))
    extra = stored(linked(scan(strong), reach), "secret-links")
    few = F.broadcast(extra) if small(extra, BROADCAST_LINKS) else extra
    rows = scan(inner, "_row", "text").alias("f").join(few.alias("x"), F.expr("f.doc_id <=> x.doc_id and f.key = x.key"), "left")
    every = rows.select("f._row", "f.text", F.array_sort(F.concat("assign", "access", "hex", F.coalesce("extra", F.expr(f"cast(array() as {_SPAN})")))).alias("z"))
    most = "(m, e) -> greatest(m, e.end)"
    before = f"greatest(aggregate(slice(t, 1, i div {_BLOCK}), 0, (m, e) -> greatest(m, e)), aggregate(slice(z, i - i % {_BLOCK} + 1, i % {_BLOCK}), 0, {most}))"
    tops = f"transform(sequence(0, (size(z) - 1) div {_BLOCK}), b -> aggregate(slice(z, b * {_BLOCK} + 1, {_BLOCK}), 0, {most}))"
    piece = f"flatten(transform(array({before}), p -> if(i = 0 or x.start >= p, array(substring(text, p + 1, x.start - p), '{mark}'), array(cast(null as string)))))"
    pieces = f"flatten(transform(array({tops}), t -> flatten(transform(z, (x, i) -> {piece}))))"
    rest = f"substring(text, aggregate(z, 0, {most}) + 1)"
    clean = every.withColumn("text", F.expr(f"if(size(z) = 0, text, concat(array_join({pieces}, ''), {rest}))"))
    new = F.when(F.col(f"_row.`{text}`").isNotNull(), F.col("text"))
    count = {"n_chars": F.when(new.isNotNull(), F.char_length("text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return clean.select(*((new if c == text else count.get(c, F.col(f"_row.`{c}`"))).alias(c) for c in docs.columns))


def secret_spans(docs: DataFrame, reach: int = REACH, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, base, spans, n_assign, n_access, n_hex) of every row; spans are arrays of (start, kind, end).

    ``base`` holds the base kinds, ``spans`` also the linked weak parts. Null and empty texts have
    none; equal rows are scanned alike and each gives its row; a null doc_id stays null; other
    columns are ignored; an empty table gives an empty result.
    """
    found = stored(scan(docs, text=text, id=id), "secret-parts")
    extra = linked(found, reach)
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = found.alias("f").join(extra.alias("x"), F.expr("f.doc_id <=> x.doc_id and f.key = x.key"), "left")
    return rows.select(
        F.col("f.doc_id").alias("doc_id"),
        base.alias("base"),
        F.array_sort(F.concat(base, F.coalesce("extra", F.expr(f"cast(array() as {_SPAN})")))).alias("spans"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
    )


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _duck(kind: int, pattern: str, keep: str) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return (
        f"SELECT doc_id, {kind} AS k, CAST(coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0) AS BIGINT) AS s, ms[i] AS v"
        f" FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {quoted}) AS ms, string_split_regex(t, {quoted}) AS ps FROM d)) WHERE {keep.replace('PATTERN', quoted).replace('v,', 'ms[i],').replace('(v)', '(ms[i])')}"
    )


OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_duck(0, ASSIGN, "length(regexp_extract(v, PATTERN, 2)) >= 12")} UNION ALL {_duck(1, ACCESS, "length(v) >= 18")} UNION ALL {_duck(2, HEX, "length(v) >= 16")}),
weak AS ({_duck(3, SECRET, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')")} UNION ALL {_duck(4, ENDPOINT_PLAIN, f"regexp_matches(v, '{_DOTTED}')")}),
linked AS (SELECT * FROM weak w WHERE EXISTS (SELECT 1 FROM base a WHERE a.doc_id = w.doc_id AND (a.k = 1 OR a.k = 0 AND w.k = 4)
  AND a.s - (w.s + length(w.v)) <= {REACH} AND w.s - (a.s + length(a.v)) <= {REACH} AND NOT (a.s <= w.s AND w.s + length(w.v) <= a.s + length(a.v)))),
named AS (SELECT doc_id, k, s, k < 3 AS is_base, ['assign', 'access', 'hex', 'secret', 'endpoint'][k + 1] || ':' || s || ':' || (s + length(v)) AS n FROM (SELECT * FROM base UNION ALL SELECT * FROM linked)),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, string_agg(n, ',' ORDER BY s, k) FILTER (is_base) AS base, string_agg(n, ',' ORDER BY s, k) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""

"""URL filters as a temporal list join, in DataFrame functions only.

Lists are logs of dated entries (list, kind, key, day, action): from that day on the key is on
the list (``add``) or off it (``remove``). Each entry becomes a validity interval that ends
where the next one of its key begins, so at any time one interval of a key is valid, and a
capture is judged by the interval of its fetch day (an as-of join). Intervals are joined by key
and month, so that a key with a long history isn't compared with every capture of it. Only keys
that some list holds are joined at all. Where the intervals are few they go to the captures;
else a key that very many captures share (the domain ``com``, say) is salted on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgrid.llm.common import small, stored, table

#: Interval rows, listed keys and hot keys that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Captures of a key, or rows of a capture, above which it is salted, and by how many salts.
HOT, SALTS = 100_000, 64
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"\.+$", "")


def keys_of(url: Column) -> Column:
    """(kind, key) of every list entry that would match: the host's suffixes and the URL's path prefixes."""
    labels = F.split(host_of(url), r"\.")
    steps = F.filter(F.split(F.regexp_extract(url, URL, 2), "/"), lambda x: x != "")
    domain = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    prefix = F.transform(
        F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("key")),
    )
    return F.when(host_of(url) != "", F.concat(domain, prefix))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, valid_from, valid_to) of every time a key is on a list; valid_to is exclusive, null while open.

    Entries of one key and day are combined before they are shuffled, ``add`` prevailing, so a key
    has at most one row a day however often it is listed. Entries without list, kind, key, day or
    known action don't count.
    """
    known = entries.where("list is not null and kind is not null and key is not null and day is not null and action in ('add', 'remove')")
    daily = known.groupBy("list", "kind", F.lower("key").alias("key"), F.col("day").cast("date").alias("valid_from")).agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    after = F.lead("valid_from").over(Window.partitionBy("list", "kind", "key").orderBy("valid_from"))
    return daily.withColumn("valid_to", after).where("on = 1").drop("on")


#: The columns that :func:`judged` adds.
ADDED = ("blocked", "n_matches", "lists", "first_match")


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """Every row of ``captures`` with ``blocked``, ``n_matches``, ``lists`` and ``first_match``.

    n_matches counts entries active on the fetch day, ``lists`` are their lists in order, joined
    by commas, ``first_match`` is the smallest list:kind:key. A null or unparsable url and a null
    day match nothing; path keys are compared in lower case; repeated captures are judged once
    and each keeps its row; columns of those names are replaced, others may have any name; empty tables are fine.
    """
    given = captures.select(
        F.struct(*(F.col(f"`{c}`") for c in captures.columns if c not in ADDED)).alias("row"), F.col(url).cast("string").alias("url"), F.col(day).cast("date").alias("day")
    )
    once = stored(given.where("url is not null and day is not null").groupBy("url", "day").agg(F.count("*").alias("rows")), "captures")
    valid = stored(intervals(entries), "intervals")
    keys = stored(valid.select("kind", "key").distinct(), "listed-keys")
    asked = once.select("url", "day", F.explode(keys_of(F.col("url"))).alias("k")).select("url", "day", "k.kind", F.lower("k.key").alias("key"))
    asked = asked.join(_near(keys), ["kind", "key"], "left_semi")
    wanted = asked.withColumn("bucket", F.explode(F.array(F.date_format("day", "yyyy-MM"), F.lit("open"))))
    months = F.transform(F.sequence(F.trunc("valid_from", "MM"), F.trunc(F.date_sub("valid_to", 1), "MM"), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    spread = valid.withColumn("bucket", F.explode(F.when(F.col("valid_to").isNull(), F.array(F.lit("open"))).otherwise(months)))
    on = ["kind", "key", "bucket"]
    if small(valid, BROADCAST_ROWS):
        active = wanted.join(F.broadcast(spread), on)
    else:
        wanted, spread = _salted(wanted, spread, ["kind", "key"], wanted.groupBy("kind", "key").agg(F.count("*").alias("rows")), F.xxhash64("url", "day"))
        active = wanted.join(spread, [*on, "salt"])
    found = active.where("day >= valid_from and (valid_to is null or day < valid_to)").groupBy("url", "day").agg(
        F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min(F.concat_ws(":", "list", "kind", "key")).alias("first_match")
    )
    # A page captured by very many rows is one row of ``once`` but all of them here.
    given, found = _salted(given, found, ["url", "day"], once, F.xxhash64(F.spark_partition_id()))
    rows = given.join(found, ["url", "day", "salt"], "left")
    return rows.select(
        *(F.col(f"row.`{c}`") for c in captures.columns if c not in ADDED),
        F.col("n_matches").isNotNull().alias("blocked"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("first_match", F.lit("")).alias("first_match"),
    )


def _near(rows: DataFrame) -> DataFrame:
    """A stored table, broadcast if it is small enough."""
    return F.broadcast(rows) if small(rows, BROADCAST_ROWS) else rows


def _salted(many: DataFrame, one: DataFrame, key: list[str], counts: DataFrame, by: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: 0, but for keys of more than :data:`HOT` rows of ``many`` a salt by ``by``; ``one`` has all salts of these.

    Of such keys there is at most one in ``HOT`` rows; they are marked by a broadcast where they are few enough for it.
    """
    hot = stored(counts.where(F.col("rows") > HOT).select(*key, F.lit(True).alias("hot")), "hot-keys")
    marked = _near(hot)
    salt = F.when(F.col("hot"), F.pmod(by, F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return many.join(marked, key, "left").withColumn("salt", salt).drop("hot"), one.join(marked, key, "left").withColumn("salt", F.explode(salts)).drop("hot")


def _number(text: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(F.md5(text), at, n), 16, 10).cast("int")


def dated_lists(pages: DataFrame) -> DataFrame:
    """A log of list entries for the hosts, parent domains and first path steps of ``pages``.

    The tables hold no lists. Of each distinct key a hash decides whether it is listed at all (one
    in four), and on which four days of 2024 it is added or removed.
    """
    host = host_of(F.col("url"))
    parent = F.regexp_replace(host, r"^[^.]+\.", "")
    first = F.concat(host, F.lit("/"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)", 1))
    named = F.array(*(F.struct(F.lit(a).alias("list"), F.lit(b).alias("kind"), c.alias("key")) for a, b, c in (("hosts", "domain", host), ("families", "domain", parent), ("sections", "prefix", first))))
    keys = pages.where("url is not null").select(F.explode(named).alias("k")).select("k.*").distinct().where("key <> '' and key not like '%/'").where(_number(F.col("key"), 1, 2) % 4 == 0)
    step = keys.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(3))))
    mark = F.concat_ws(":", "list", "key", "n")
    return step.select("list", "kind", "key", F.date_add(F.lit("2024-01-01").cast("date"), _number(mark, 1, 4) % 366).alias("day"), F.when(_number(mark, 5, 2) % 3 == 0, "remove").otherwise("add").alias("action"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the lists as they were on its fetch day, here a day of 2024 by page_id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")))
    found = judged(captures, dated_lists(pages))
    return found.select("page_id", "url", F.date_format("fetch_day", "yyyy-MM-dd").alias("fetch_day"), "blocked", "n_matches", "lists", "first_match")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS d,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)[^/?#]*([^?#]*)', 1)), '\.+$', '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)[^/?#]*([^?#]*)', 2), '/'), lambda x: x <> '') AS steps
  FROM pages),
k AS (
  SELECT DISTINCT unnest(['hosts', 'families', 'sections']) AS list, unnest(['domain', 'domain', 'prefix']) AS kind,
         unnest([host, regexp_replace(host, '^[^.]+\.', ''), host || '/' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)', 1)]) AS key
  FROM p WHERE url IS NOT NULL),
e AS (
  SELECT list, kind, lower(key) AS key, DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(list || ':' || key || ':' || n), 1, 4) AS INTEGER) % 366 AS INTEGER) AS f,
         CAST('0x' || substr(md5(list || ':' || key || ':' || n), 5, 2) AS INTEGER) % 3 <> 0 AS a
  FROM k, (SELECT unnest([0, 1, 2, 3]) AS n)
  WHERE key <> '' AND NOT suffix(key, '/') AND CAST('0x' || substr(md5(key), 1, 2) AS INTEGER) % 4 = 0),
g AS (SELECT list, kind, key, f, bool_or(a) AS a FROM e GROUP BY ALL),
v AS (SELECT *, lead(f) OVER (PARTITION BY list, kind, key ORDER BY f) AS t FROM g),
c AS (
  SELECT page_id, d, 'domain' AS kind, lower(array_to_string(string_split(host, '.')[i:], '.')) AS key FROM p, unnest(range(1, len(string_split(host, '.')) + 1)) AS r(i) WHERE host <> ''
  UNION ALL
  SELECT page_id, d, 'prefix', lower(host || '/' || array_to_string(steps[1:i], '/')) FROM p, unnest(range(1, len(steps) + 1)) AS r(i) WHERE host <> ''),
m AS (
  SELECT page_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, min(list || ':' || v.kind || ':' || v.key) AS first
  FROM c JOIN v ON c.kind = v.kind AND c.key = v.key AND v.a AND c.d >= v.f AND (v.t IS NULL OR c.d < v.t) GROUP BY page_id)
SELECT p.page_id, url, strftime(d, '%Y-%m-%d') AS fetch_day, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_matches, coalesce(lists, '') AS lists, coalesce(first, '') AS first_match
FROM p LEFT JOIN m USING (page_id)
"""

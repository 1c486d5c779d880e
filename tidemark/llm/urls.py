"""URL filters by a temporal list join.

A block list's dated entries (add, remove) become validity intervals: an addition holds until the
next entry for the same pattern. Each capture is then joined as of its fetch date with the entries
active on that day, by host, by parent domain, or by host and first path segment.

Captures are first reduced to distinct (host, segment, day), so a hot host costs a row a day and
segment; all joins are equalities that Spark can split at hot keys.

A host is compared without user, port, case, percent encoding and closing dots, and so are a list's
patterns, so that none of them leads past a list. A backslash ends a host as a slash does.

Defined results: entries of one pattern on the same day act in the order add, remove, so the pattern
ends inactive; an addition to an active pattern renews it; a null URL or day, or a URL without a host,
matches nothing and is allowed; a null pattern or day in the list counts for nothing; repeated captures
are judged each; an empty list allows all; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import place, plain

#: Scheme, user, host and the rest of a URL. Leading white space and control characters don't count.
_HOST = r"^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}(?:[^/?#\\]*@)?(\[[^\]/?#\\]*\]|[^/?#:@\\]*)"
_SEGMENT = r"^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}[^/?#\\]+[/\\]([^/?#\\]+)"


def decoded(text: Column) -> Column:
    """Percent sequences decoded; a text with broken ones stays as it is."""
    return F.coalesce(F.when(F.contains(text, F.lit("%")), F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))), text)


def normal(host: Column) -> Column:
    return F.regexp_replace(F.lower(decoded(host)), r"\.+$", "")


def host(url: Column) -> Column:
    return normal(F.regexp_extract(url, _HOST, 1))


def segment(url: Column) -> Column:
    return decoded(F.regexp_extract(url, _SEGMENT, 1))


def pattern(entry: Column) -> Column:
    """A list's pattern with its host, which is all before the first slash, as hosts of captures are compared."""
    path = F.regexp_extract(entry, r"^[^/]*(/.*)?$", 1)
    return F.concat(normal(F.regexp_extract(entry, r"^([^/]*)", 1)), decoded(path))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to) of entries (list, kind, pattern, action, on_date); valid_to is null while open."""
    w = Window.partitionBy("list", "kind", "pattern").orderBy("on_date", "action")
    return (
        entries.filter(F.col("on_date").isNotNull() & F.col("pattern").isNotNull())
        .select("list", "kind", pattern(F.col("pattern")).alias("pattern"), "action", "on_date").distinct()
        .withColumn("valid_to", F.lead("on_date").over(w))
        .filter((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("on_date"))))
        .select("list", "kind", "pattern", F.col("on_date").alias("valid_from"), "valid_to")
    )


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures (with ``url``, ``fetch_date``) and host, n_active, matched (the newest active pattern) and allowed."""
    url, day = F.col(place(captures, "url")), F.col(place(captures, "fetch_date"))
    known = plain(captures).select("*", host(url).alias("host"), segment(url).alias("segment"), day.alias("fetch_date"))
    probe = known.filter((F.col("host") != "") & F.col("fetch_date").isNotNull()).select("host", "segment", "fetch_date").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    keys = F.concat(parents, F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")), F.struct(F.lit("path").alias("kind"), F.concat_ws("/", "host", "segment").alias("pattern"))))
    probe = probe.select("*", F.inline(keys))
    found = probe.join(intervals(entries), ["kind", "pattern"]).filter((F.col("valid_from") <= F.col("fetch_date")) & (F.col("valid_to").isNull() | (F.col("fetch_date") < F.col("valid_to"))))
    # The newest entry; among equals the first list, kind and pattern.
    order = F.struct(F.datediff(F.lit("2200-01-01"), "valid_from").alias("age"), "list", "kind", "pattern")
    verdict = found.groupBy("host", "segment", "fetch_date").agg(F.count("*").alias("n_active"), F.min(order).alias("best"))
    verdict = verdict.select("host", "segment", "fetch_date", "n_active", F.concat_ws(":", "best.list", "best.kind", "best.pattern").alias("matched"))
    out = known.join(verdict, ["host", "segment", "fetch_date"], "left")
    n = F.coalesce("n_active", F.lit(0))
    return out.select(*plain(captures).columns, "host", n.alias("n_active"), "matched", (n == 0).alias("allowed")).toDF(*captures.columns, "host", "n_active", "matched", "allowed")


#: The query's captures and list: fetch days from page ids, entries from hashes of hosts and paths.
_DAY = "date_add(DATE '2024-01-01', CAST(pmod(page_id * 37, 365) AS INT))"


def proxy_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and first path segments of the pages, decided by hashes of the patterns."""
    at = pages.select(host(F.col("url")).alias("host"), segment(F.col("url")).alias("segment")).filter(F.col("host") != "")
    hosts = at.select(F.lit("host").alias("kind"), F.col("host").alias("pattern")).distinct()
    domains = at.select(F.lit("domain").alias("kind"), F.regexp_extract("host", r"^[^.]+\.(.*)$", 1).alias("pattern")).filter("pattern != ''").distinct()
    paths = at.filter(F.col("segment") != "").select(F.lit("path").alias("kind"), F.concat_ws("/", "host", "segment").alias("pattern")).distinct()
    hashed = hosts.unionByName(domains).unionByName(paths).withColumn("h", F.md5("pattern"))
    part = lambda k: F.conv(F.substring("h", k, 2), 16, 10).cast("int")
    start = F.date_add(F.lit("2024-01-01").cast("date"), part(3) % 300)
    days = lambda n: F.date_add(start, n)
    each = F.array(
        F.struct(F.lit("add").alias("action"), start.alias("on_date"), (part(1) < 64).alias("use")),
        F.struct(F.lit("remove").alias("action"), days(part(5) % 90 + 1).alias("on_date"), (part(1) < 48).alias("use")),
        F.struct(F.lit("add").alias("action"), days(part(5) % 90 + 30).alias("on_date"), (part(1) < 24).alias("use")),
    )
    return hashed.select(F.concat(F.lit("list"), (part(7) % 3).cast("string")).alias("list"), "kind", "pattern", F.inline(each)).filter("use").drop("use")


def op10_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = filter_captures(pages.withColumn("fetch_date", F.expr(_DAY)), proxy_entries(pages))
    return out.select("page_id", "host", "fetch_date", "n_active", F.coalesce("matched", F.lit("")).alias("matched"), "allowed")


def decoded_sql(x: str) -> str:
    return f"CASE WHEN contains({x}, '%') THEN coalesce(try(url_decode({x})), {x}) ELSE {x} END"


def oracle_sql() -> str:
    plain_host = lambda h: f"regexp_replace(lower({decoded_sql(h)}), '\\.+$', '')"
    byte = lambda k: f"CAST(concat('0x', substr(h, {k}, 2)) AS BIGINT)"
    return rf"""
WITH known AS (
    SELECT page_id, {plain_host(f"regexp_extract(url, '{_HOST}', 1)")} AS host, {decoded_sql(f"regexp_extract(url, '{_SEGMENT}', 1)")} AS segment,
        CAST(DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS DATE) AS fetch_date FROM pages),
sites AS (SELECT DISTINCT host, segment FROM known WHERE host <> ''),
patterns AS (
    SELECT 'host' AS kind, host AS pattern FROM sites UNION
    SELECT 'domain', regexp_extract(host, '^[^.]+\.(.*)$', 1) FROM sites WHERE regexp_extract(host, '^[^.]+\.(.*)$', 1) <> '' UNION
    SELECT 'path', host || '/' || segment FROM sites WHERE segment <> ''),
hashed AS (SELECT *, md5(pattern) AS h FROM patterns),
numbers AS (SELECT kind, pattern, {byte(1)} AS p1, CAST(DATE '2024-01-01' + CAST({byte(3)} % 300 AS INTEGER) AS DATE) AS start,
    CAST({byte(5)} % 90 AS INTEGER) AS gap, 'list' || ({byte(7)} % 3) AS list FROM hashed),
entries AS (
    SELECT list, kind, pattern, 'add' AS action, start AS on_date FROM numbers WHERE p1 < 64 UNION
    SELECT list, kind, pattern, 'remove', CAST(start + gap + 1 AS DATE) FROM numbers WHERE p1 < 48 UNION
    SELECT list, kind, pattern, 'add', CAST(start + gap + 30 AS DATE) FROM numbers WHERE p1 < 24),
led AS (SELECT *, lead(on_date) OVER (PARTITION BY list, kind, pattern ORDER BY on_date, action) AS valid_to FROM entries),
valid AS (SELECT * FROM led WHERE action = 'add' AND (valid_to IS NULL OR valid_to > on_date)),
hits AS (
    SELECT k.page_id, v.list, v.kind, v.pattern, v.on_date FROM known k JOIN valid v
    ON (CASE v.kind WHEN 'host' THEN k.host = v.pattern WHEN 'domain' THEN k.host = v.pattern OR ends_with(k.host, '.' || v.pattern) ELSE k.host || '/' || k.segment = v.pattern END)
    AND v.on_date <= k.fetch_date AND (v.valid_to IS NULL OR k.fetch_date < v.valid_to) WHERE k.host <> ''),
best AS (SELECT page_id, count(*) OVER (PARTITION BY page_id) AS n, list || ':' || kind || ':' || pattern AS matched,
    row_number() OVER (PARTITION BY page_id ORDER BY on_date DESC, list, kind, pattern) AS rn FROM hits)
SELECT k.page_id, k.host, k.fetch_date, CAST(coalesce(b.n, 0) AS BIGINT) AS n_active, coalesce(b.matched, '') AS matched, coalesce(b.n, 0) = 0 AS allowed
FROM known k LEFT JOIN best b ON k.page_id = b.page_id AND b.rn = 1"""

"""Queries over the driver's tables, each beside its SQL for DuckDB."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checks import integrity
from ..functions import net, risk, text, url
from ..operators import identity, merge, reports, scan, states, tracker
from ..sources import boards, jobboard, listings, markdown

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dropped(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may be over; its folder goes with it
        listings.remove(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, or a local one where all runs on this machine; it goes when the driver's process ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_dropped, spark, path)
    return path


# Fixed values of these queries: which indicator an event stands for, and filters.
EVENT_CODES = {"error": "C1", "purchase": "H1", "signup": "M1", "view": "M2", "click": "L1"}
TITLE_TERMS, LOCATION_TERMS = ("ring", "WIDGET"), ("promo",)
_RISKS = "CASE WHEN o_orderpriority LIKE '1-%' THEN 'Critical' WHEN o_orderpriority LIKE '2-%' THEN 'High' WHEN o_orderpriority LIKE '3-%' THEN 'Medium' WHEN o_orderpriority LIKE '5-%' THEN 'Low' ELSE '—' END"
_HOST = r"lower(string_split(string_split(list_extract(string_split(regexp_replace(url, '[/?#]+', '/', 'g'), '/'), 2), '@')[-1], ':')[1])"
_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_PARAMS = "list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT (lower(string_split(x, '=')[1]) IN ('ref', 'referrer') OR lower(x) LIKE 'utm\\_%' ESCAPE '\\'))"
_BASE = "regexp_extract(url, '^([^?#]*)', 1)"
_PATH = f"regexp_replace({_BASE}, '^https?://[^/]*', '')"
_TRIMMED = f"CASE WHEN length({_PATH}) > 1 THEN rtrim({_PATH}, '/') WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END"
_URL_NORM = f"lower(regexp_extract({_BASE}, '^(https?://[^/]*)', 1)) || ({_TRIMMED}) || CASE WHEN len({_PARAMS}) > 0 THEN '?' || array_to_string(list_sort({_PARAMS}), '&') ELSE '' END"


def _risk_of(priority: str = "o_orderpriority"):
    """Priorities like ``1-URGENT`` as risk levels; what is none becomes the dash."""
    names = {"1": "Critical", "2": "High", "3": "Medium", "5": "Low"}
    out = F.lit(text.DASH)
    for n, name in names.items():
        out = F.when(F.startswith(F.col(priority), F.lit(f"{n}-")), name).otherwise(out)
    return out


@query(f"SELECT o_orderkey, o_orderstatus AS status, {_RISKS} AS risk FROM orders WHERE o_orderstatus = 'O' AND lower({_RISKS}) = 'critical' AND contains(lower(o_orderpriority), 'urg') ORDER BY o_orderkey LIMIT 100")
def tracker_query(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("status"), _risk_of().alias("risk"), F.col("o_orderpriority").alias("title"), F.lit("").alias("company"), F.lit("").alias("notes"), F.lit(False).alias("malformed"))
    return tracker.find(rows, states.Catalog(), status="O", risk="critical", text="URG", limit=100).select("o_orderkey", "status", "risk")


@query(f"SELECT {_RISKS} AS risk, count(*) AS n, sum(CASE WHEN {_RISKS} = '—' THEN 1 ELSE 0 END)::BIGINT AS sentinels FROM orders GROUP BY 1")
def canonicalize_enum(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(_risk_of().alias("cell"))
    canonical = F.coalesce(text.resolved(F.col("cell"), risk.LEVELS), F.lit(text.DASH))
    return rows.groupBy(canonical.alias("risk")).agg(F.count("*").alias("n"), F.count_if(text.is_sentinel(F.col("cell"))).cast("long").alias("sentinels"))


@query(f"SELECT page_id, {_URL_NORM} AS url_norm FROM pages")
def url_identity(spark, sf_dir):
    """Python sees only the URLs that SQL can't do."""
    return url.with_normalized(read(spark, sf_dir, "pages").select("page_id", "url"), "url", "url_norm").select("page_id", "url_norm")


@query(f"WITH p AS (SELECT page_id, {_URL_NORM} AS url_norm FROM pages) SELECT page_id, url_norm, CASE WHEN page_id > f THEN f END AS duplicate_of FROM (SELECT *, min(page_id) OVER (PARTITION BY url_norm) AS f FROM p)")
def url_dedup_first(spark, sf_dir):
    rows = url.with_normalized(read(spark, sf_dir, "pages").select("page_id", "url"), "url", "url_norm")
    return identity.first_wins(rows, "url_norm", "page_id", "page_id").select("page_id", "url_norm", "duplicate_of")


@query(f"SELECT page_id, host, CASE WHEN page_id > f THEN f END AS duplicate_of FROM (SELECT page_id, {_HOST} AS host, min(page_id) OVER (PARTITION BY {_HOST}) AS f FROM pages)")
def host_dedup_first(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", url.host(F.col("url")).alias("host"))
    return identity.first_wins(rows, "host", "page_id", "page_id").select("page_id", "host", "duplicate_of")


@query("SELECT doc_id, CASE WHEN doc_id > f THEN f END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents)")
def text_dedup_first(spark, sf_dir):
    """Keyed by a digest, so that no text is shuffled."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return identity.first_wins(rows, "key", "doc_id", "doc_id").select("doc_id", "duplicate_of")


@query(f"SELECT p_partkey, {_SLUG.format('p_name')} AS name_slug, {_SLUG.format('p_brand')} AS brand_slug FROM part")
def slug_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("name_slug"), text.slug(F.col("p_brand")).alias("brand_slug"))


@query(f"SELECT p_partkey, 'title:' || {_SLUG.format('p_name')} || '|src:' || {_SLUG.format('p_brand')} AS identity, min(p_partkey) OVER (PARTITION BY {_SLUG.format('p_name')}, {_SLUG.format('p_brand')}) AS first_key FROM part")
def title_source_key(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", url.identity(F.lit(""), F.col("p_name"), F.col("p_brand")).alias("identity"))
    rows = identity.first_wins(rows, "identity", "p_partkey", "p_partkey")
    return rows.select("p_partkey", "identity", F.coalesce("duplicate_of", "p_partkey").alias("first_key"))


@query("SELECT count(*) AS postings, count(*) FILTER (WHERE s = 'added') AS added, 0::BIGINT AS duplicate, count(*) FILTER (WHERE s = 'skipped_title') AS skipped_title, count(*) FILTER (WHERE s = 'skipped_location') AS skipped_location, 0::BIGINT AS no_provider, 0::BIGINT AS invalid_posting, 0::BIGINT AS error FROM (SELECT CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'widget') THEN 'skipped_title' WHEN contains(lower(p_type), 'promo') THEN 'skipped_location' ELSE 'added' END AS s FROM part)")
def blacklist_filter(spark, sf_dir):
    status = F.when(scan.contains_any(F.col("p_name"), TITLE_TERMS), "skipped_title").when(scan.contains_any(F.col("p_type"), LOCATION_TERMS), "skipped_location").otherwise("added")
    return scan.counts(read(spark, sf_dir, "part").select(status.alias("status")))


_SCAN = f"""WITH p AS (SELECT page_id, {_URL_NORM} AS url_norm, {_HOST} AS host, regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT url_norm FROM p WHERE page_id % 7 = 0), f AS (SELECT *, min(page_id) FILTER (WHERE page_id % 11 <> 3) OVER (PARTITION BY url_norm) AS first FROM p),
s AS (SELECT page_id, f.url_norm, f.host, CASE WHEN page_id % 11 = 3 THEN 'invalid_posting' WHEN h.url_norm IS NOT NULL AND page_id % 2 = 0 OR first < page_id THEN 'duplicate' WHEN contains(lower(path), CASE WHEN page_id % 3 = 0 THEN '/de/' ELSE '/fr/' END) THEN 'skipped_title' WHEN contains(lower(f.host), 'blog') THEN 'skipped_location' ELSE 'added' END AS status FROM f LEFT JOIN h ON f.url_norm = h.url_norm AND page_id % 2 = 0)
"""


def _scanned(spark, sf_dir):
    """All pages as postings of entries, each with terms of its own; every seventh page's URL is known to the entries of even pages.

    URLs are taken apart once, and what they give is written down: a scan reads its postings for their first places and again for their status.
    """
    at = scratch(spark, "pages")
    url.with_normalized(read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://[^/]*(/[^?#]*)", 1).alias("path")), "url", "url_norm", "host").drop("url").write.parquet(at)
    pages = spark.read.schema("page_id long, path string, url_norm string, host string").parquet(at)
    even = F.col("page_id") % 2 == 0
    seen = pages.filter("page_id % 7 = 0").select(F.concat(F.lit("0"), "url_norm").alias("key"))
    terms = F.array(F.when(F.col("page_id") % 3 == 0, "/de/").otherwise("/fr/"))
    rows = pages.withColumns({"known": F.when(even, F.concat(F.lit("0"), "url_norm")), "terms": terms})
    rows = rows.join(seen.distinct().withColumn("seen", F.lit(True)), F.col("known") == F.col("key"), "left")
    found = scan.statuses(rows.drop("key", "known"), seen.limit(0).select(F.col("key").alias("url_norm")), "url_norm", ["page_id"], F.col("path"), F.col("host"), F.col("terms"), ("blog",), F.col("page_id") % 11 != 3)
    return found.withColumn("status", F.when(F.col("seen") & (F.col("status") != "invalid_posting"), "duplicate").otherwise(F.col("status")))


@query(_SCAN + "SELECT page_id, url_norm, status FROM s")
def scan_status_precedence(spark, sf_dir):
    return _scanned(spark, sf_dir).select("page_id", "url_norm", "status")


@query(_SCAN + "SELECT page_id, status FROM s WHERE (SELECT count(*) FROM s AS t WHERE t.status = 'added' AND t.page_id < s.page_id) < 10")
def scan_limit(spark, sf_dir):
    """The cap on added rows is the reference's own feature: rows after the 10th added don't exist."""
    return scan.capped(_scanned(spark, sf_dir), "page_id", 10).select("page_id", "status")


@query(_SCAN + "SELECT count(*) AS postings, " + ", ".join(f"count(*) FILTER (WHERE status = '{k}') AS {k}" for k in scan.STATUSES) + " FROM (SELECT status FROM s)")
def scan_counts(spark, sf_dir):
    return scan.counts(_scanned(spark, sf_dir))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def merge_anti(spark, sf_dir):
    rows = identity.merged(read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "quality")
    return rows.filter("duplicate_of is null").select("doc_id", "source")


@query("SELECT d.doc_id, min(l.toxic)::BIGINT AS duplicate_of FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id")
def merge_skipped(spark, sf_dir):
    rows = identity.merged(read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").select("doc_id"), "doc_id", "toxic")
    return rows.filter("duplicate_of is not null").select("doc_id", F.col("duplicate_of").cast("long").alias("duplicate_of"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphans(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY user_id), c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'click' WHEN c_custkey % 5 = 1 THEN 'error' ELSE 'view' END AS status FROM customer)
SELECT coalesce(c_custkey, user_id) AS id, CASE WHEN c_custkey IS NULL THEN 'log_only' WHEN user_id IS NULL THEN 'table_only' WHEN latest = status THEN 'match' ELSE 'mismatch' END AS state FROM l FULL JOIN c ON c_custkey = user_id""")
def full_sync(spark, sf_dir):
    latest = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
    status = F.when(F.col("c_custkey") % 5 == 0, "click").when(F.col("c_custkey") % 5 == 1, "error").otherwise("view")
    return identity.synced(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), status.alias("status")), latest, "id", "status", "latest").select("id", "state")


@query("SELECT d.doc_id, coalesce(a.quality, b.quality)::BIGINT AS filled FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id - 1")
def missing_backfill(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("long").alias("filled"))
    before = labels.select((F.col("doc_id") + 1).alias("doc_id"), "quality")
    return identity.missing_filled(rows, "filled", (labels, "doc_id", "quality"), (before, "doc_id", "quality")).select("doc_id", "filled")


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderkey")
    found = identity.groups_of_several(rows, ["o_custkey", "d"], F.col("o_orderkey"))
    members = F.array_join(F.transform("members", lambda x: x.cast("string")), ",")
    return found.select("o_custkey", F.date_format("d", "yyyy-MM-dd").alias("day"), "n", members.alias("members"))


@query("SELECT conv_id, role, turn, rn - 1 AS occurrence FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations) WHERE rn > 1")
def dup_occurrence(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.col("turn").alias("pos"), F.struct("conv_id", "role").alias("key"))
    return tracker.occurrences(rows, "key").select("conv_id", "role", "turn", F.col("occurrence").cast("long").alias("occurrence"))


@query("SELECT (coalesce(max(k), 0) + 1)::BIGINT AS next_num, count(DISTINCT k) AS used FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT p_partkey FROM part)")
def next_number(spark, sf_dir):
    keys = (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))
    return identity.next_number(*(read(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in keys))


@query(_SCAN + "SELECT page_id, host, row_number() OVER (ORDER BY page_id) + (SELECT max(page_id) FROM pages WHERE page_id % 7 = 0) AS num FROM s WHERE status = 'added'")
def assign_numbers(spark, sf_dir):
    """The first number comes with the rows: no job runs while the plan is built."""
    start = read(spark, sf_dir, "pages").filter("page_id % 7 = 0").agg((F.coalesce(F.max("page_id"), F.lit(0)) + 1).alias("start"))
    new = _scanned(spark, sf_dir).filter("status = 'added'").crossJoin(F.broadcast(start))  # one row
    return identity.numbered(new, ["page_id"], F.col("start")).select("page_id", "host", "num")


_CODE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_CODES.items()) + " END"
_RISK = f"""WITH g AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list_sort(list(DISTINCT {_CODE})) AS codes FROM events GROUP BY 1, 2),
n AS (SELECT *, list_contains(codes, 'C1') AS c, list_contains(codes, 'H1') AS h, list_contains(codes, 'M1')::INT + list_contains(codes, 'M2')::INT AS m, list_contains(codes, 'L1') AS l FROM g),
r AS (SELECT *, CASE WHEN c THEN 'Critical' WHEN h AND m >= 2 THEN 'High' WHEN h OR m >= 2 THEN 'Medium' ELSE 'Low' END AS level FROM n)
"""


def _assessed(spark, sf_dir):
    code = F.create_map(*(F.lit(x) for kv in EVENT_CODES.items() for x in kv))[F.col("event_type")]
    days = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.sort_array(F.collect_set(code)).alias("codes"))
    return days.select("user_id", F.date_format("d", "yyyy-MM-dd").alias("day"), "codes", risk.level(F.col("codes")).alias("level"))


@query(_RISK + """SELECT user_id, day, array_to_string(codes, ',') AS codes, level, CASE WHEN level IN ('Critical', 'High') THEN 'Suspicious' WHEN level = 'Medium' THEN 'Proceed with Caution' ELSE 'High Confidence' END AS tier,
CASE WHEN c OR h THEN CASE WHEN list_contains(codes, 'M1') THEN 'Ghost/Stale,Scam' ELSE 'Scam' END WHEN list_contains(codes, 'M1') THEN 'Ghost/Stale,Suspicious' ELSE 'Suspicious' END AS categories,
CASE WHEN len(codes) >= 4 OR c::INT + h::INT >= 2 THEN 'High' WHEN level <> 'Low' THEN 'Medium' WHEN len(codes) >= 2 THEN 'Medium' WHEN l THEN 'Low' ELSE 'Medium' END AS confidence FROM r""")
def risk_assess(spark, sf_dir):
    found = F.col("codes")
    rows = _assessed(spark, sf_dir)
    return rows.select("user_id", "day", F.array_join("codes", ",").alias("codes"), "level", risk.tier(F.col("level")).alias("tier"), F.array_join(risk.categories(found), ",").alias("categories"), risk.confidence(found, F.col("level")).alias("confidence"))


@query(_RISK + "SELECT user_id, day, c::BIGINT AS critical, h::BIGINT AS high, m::BIGINT AS medium, l::BIGINT AS low FROM r")
def severity_hist(spark, sf_dir):
    rows = _assessed(spark, sf_dir)
    return rows.select("user_id", "day", *(risk.count(F.col("codes"), k).cast("long").alias(v.lower()) for k, v in risk.SEVERITIES.items()))


@query(_RISK + f", o AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1), q AS (SELECT o.o_custkey, {_RISKS} AS claimed FROM o JOIN orders ON o_orderkey = k) SELECT user_id, day, level, claimed FROM r JOIN q ON user_id = o_custkey WHERE claimed <> '—' AND claimed <> level")
def risk_contradiction(spark, sf_dir):
    claimed = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(_risk_of(), "o_orderkey").alias("claimed"))
    rows = _assessed(spark, sf_dir).join(claimed.filter(F.col("claimed") != text.DASH), F.col("user_id") == F.col("o_custkey"))
    return rows.filter(F.col("claimed") != F.col("level")).select("user_id", "day", "level", "claimed")


@query("""WITH r AS (SELECT conv_id, turn, role, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS k FROM conversations), l AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM r)
SELECT conv_id, count(*) FILTER (WHERE k <= p) AS violations, min(turn) FILTER (WHERE k <= p) AS first_turn FROM l GROUP BY conv_id""")
def section_order(spark, sf_dir):
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    before = F.lag("k").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", rank.alias("k")).withColumn("bad", F.col("k") <= before)
    return rows.groupBy("conv_id").agg(F.count_if("bad").cast("long").alias("violations"), F.min(F.when(F.col("bad"), F.col("turn"))).alias("first_turn"))


@query(r"SELECT doc_id, regexp_matches(text, '\*\*[^*]+\*\*') AS bold, regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') AS control FROM documents")
def bold_control_chars(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.bold(F.col("text")).alias("bold"), text.control_bytes(F.col("text")).alias("control"))


VERDICT = reports.VERDICT


@query(rf"SELECT doc_id, regexp_matches(text || ' ' || CASE WHEN doc_id % 5 = 0 THEN 'This is a  SCAM.' ELSE 'thisis scam' END, '{VERDICT}') AS verdict FROM documents")
def verdict_language(spark, sf_dir):
    """The tables hold no verdicts, so every fifth text gets one and the others a near miss."""
    tail = F.when(F.col("doc_id") % 5 == 0, "This is a  SCAM.").otherwise("thisis scam")
    return read(spark, sf_dir, "documents").select("doc_id", F.rlike(F.concat_ws(" ", "text", tail), F.lit(VERDICT)).alias("verdict"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def header_field_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing') IS NULL AS missing FROM events")
def json_paths(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return rows.select("event_id", boards.scalar(F.col("v"), "k").cast("long").alias("k"), boards.scalar(F.col("v"), "missing").isNull().alias("missing"))


@query("SELECT event_id, strftime(make_timestamp((1700000000 + event_id) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS of_seconds, strftime(make_timestamp((1700000000123 + event_id * 977) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS of_millis FROM events")
def epoch_iso(spark, sf_dir):
    """Times of 13 digits and more are milliseconds, others seconds."""
    iso = lambda n: boards.iso_time(n.cast("string"))
    return read(spark, sf_dir, "events").select("event_id", iso(F.col("event_id") + 1_700_000_000).alias("of_seconds"), iso(F.col("event_id") * 977 + 1_700_000_000_123).alias("of_millis"))


_RANGES = " UNION ALL ".join(f"SELECT {a} AS lo, {b} AS hi" for a, b in map(net.bounds, net.BLOCKED))


@query(f"WITH a AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS n FROM orders) SELECT o_orderkey, ((n // 16777216)::BIGINT || '.' || (n // 65536 % 256)::BIGINT || '.' || (n // 256 % 256)::BIGINT || '.' || (n % 256)::BIGINT) AS address, EXISTS (SELECT 1 FROM ({_RANGES}) r WHERE n BETWEEN lo AND hi) AS blocked FROM a")
def ip_range_join(spark, sf_dir):
    n = (F.col("o_orderkey") * 2654435761) % 4294967296
    octets = [F.floor(n / 16777216), F.floor(n / 65536) % 256, F.floor(n / 256) % 256, n % 256]
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(".", *(x.cast("long").cast("string") for x in octets)).alias("address"))
    return rows.withColumn("blocked", net.blocked(net.to_int(F.col("address"))))


@query(f"SELECT page_id, h AS host, h = 'example.com' OR h LIKE '%.example.com' AS fits, h = 'ample.com' OR h LIKE '%.ample.com' AS near_miss FROM (SELECT page_id, {_HOST} AS h FROM pages)")
def host_suffix(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", url.host(F.col("url")).alias("host"))
    return rows.select("page_id", "host", url.has_suffix(F.col("host"), "example.com").alias("fits"), url.has_suffix(F.col("host"), "ample.com").alias("near_miss"))


ROUTES = (("blog.", "blogs"), ("m.", "mobile"), ("www.", "plain"))


@query(f"SELECT page_id, CASE WHEN h LIKE '%.org' THEN 'org' WHEN h LIKE 'blog.%' THEN 'blogs' WHEN h LIKE 'm.%' THEN 'mobile' WHEN h LIKE 'www.%' THEN 'plain' ELSE 'no_provider' END AS provider FROM (SELECT page_id, {_HOST} AS h FROM pages)")
def route_first_provider(spark, sf_dir):
    h = url.host(F.col("url"))
    out = F.when(url.has_suffix(h, "org"), "org")
    for prefix, name in ROUTES:
        out = out.when(F.startswith(h, F.lit(prefix)), name)
    return read(spark, sf_dir, "pages").select("page_id", out.otherwise("no_provider").alias("provider"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types, len(list_filter(list(DISTINCT event_type), lambda x: x NOT IN ('click', 'view', 'signup'))) = 0 AS contained FROM events GROUP BY 1, 2")
def set_subset(spark, sf_dir):
    """The types of each user's day, of all events, in a set of three."""
    sets = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.sort_array(F.collect_set("event_type")).alias("t"))
    return sets.select("user_id", F.date_format("d", "yyyy-MM-dd").alias("day"), F.array_join("t", ",").alias("types"), (F.size(F.array_except("t", F.array(*map(F.lit, ("click", "view", "signup"))))) == 0).alias("contained"))


@query("SELECT r_regionkey * 10 + 1 AS first, r_regionkey * 10 + count(n_nationkey) AS last FROM region LEFT JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 GROUP BY r_regionkey")
def release_difference(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).count()
    rows = read(spark, sf_dir, "region").join(nations, "r_regionkey", "left")
    held = rows.select((F.col("r_regionkey") * 10 + 1).alias("start"), (F.col("r_regionkey") * 10 + F.coalesce("count", F.lit(0))).cast("long").alias("end"), F.col("r_regionkey").alias("pos"))
    label = held.filter("pos = 2").select(F.concat_ws("-", "start", "end")).first()[0]
    return identity.released(held, label).select(F.col("start").alias("first"), F.col("end").alias("last"))


@query("""SELECT 1::BIGINT AS check_id, CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) > 0 THEN 'error' ELSE 'ok' END AS level, count(*) FILTER (WHERE c_acctbal < 0) AS messages FROM customer
UNION ALL SELECT 2, CASE WHEN count(*) > 0 THEN 'warn' ELSE 'ok' END, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 3, CASE WHEN count(*) > 0 THEN 'error' ELSE 'ok' END, count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 4, CASE WHEN count(*) > 0 THEN 'error' ELSE 'ok' END, count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def check_rollup(spark, sf_dir):
    customer, documents = read(spark, sf_dir, "customer"), read(spark, sf_dir, "documents")
    found = {
        (1, "error"): customer.filter("c_acctbal < 0"),
        (2, "warn"): documents.join(read(spark, sf_dir, "labels"), "doc_id", "left_anti"),
        (3, "error"): read(spark, sf_dir, "orders").groupBy("o_orderkey").count().filter("count > 1"),
        (4, "error"): documents.groupBy(F.sha2("text", 256)).count().filter("count > 1"),
    }
    rows = None
    for (number, level), df in found.items():
        n = df.agg(F.count("*").alias("messages")).select(F.lit(number).cast("long").alias("check_id"), F.when(F.col("messages") > 0, level).otherwise("ok").alias("level"), "messages")
        rows = n if rows is None else rows.unionByName(n)
    return rows


@query("SELECT p_partkey, (SELECT count(*) FROM part q WHERE q.p_size < p.p_size) + 1 AS by_number, (SELECT count(*) FROM part q WHERE q.p_size::VARCHAR < p.p_size::VARCHAR) + 1 AS by_text FROM part p")
def numeric_sort(spark, sf_dir):
    """Ranks from the counts of each size, so that no task sorts all parts."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    sizes = part.groupBy("p_size").count()  # a handful of rows
    before = lambda order: F.coalesce(F.sum("count").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1
    ranks = sizes.select("p_size", before(F.col("p_size")).alias("by_number"), before(F.col("p_size").cast("string")).alias("by_text"))
    return part.join(ranks, "p_size").select("p_partkey", "by_number", "by_text")


@query(f"SELECT s_suppkey, CASE WHEN s_suppkey < 1000 THEN lpad(s_suppkey::VARCHAR, 3, '0') ELSE s_suppkey::VARCHAR END AS label, CASE WHEN s_suppkey < 1000 THEN lpad(s_suppkey::VARCHAR, 3, '0') ELSE s_suppkey::VARCHAR END || '-' || {_SLUG.format('s_name')} || '.md' AS report FROM supplier")
def pad_labels(spark, sf_dir):
    label = text.padded(F.col("s_suppkey"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", label.alias("label"), F.concat(label, F.lit("-"), text.slug(F.col("s_name")), F.lit(".md")).alias("report"))


@query("SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 7 DAY AS stale FROM orders")
def stale_ranges(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    return rows.select("o_orderkey", identity.stale(rows, F.lit("1998-06-01T00:00:00Z").cast("timestamp")).alias("stale"))


@query(f"""WITH p AS (SELECT page_id, {_URL_NORM} AS url_norm, {_HOST} AS host FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY host) AS first FROM p WHERE NOT contains(host, 'spam'))
SELECT page_id, url_norm, host, row_number() OVER (ORDER BY page_id) AS num FROM f WHERE page_id = first""")
def staged_pipeline(spark, sf_dir):
    """Identities and hosts at once, a filter, the first of each host by one aggregation, numbers by ranges."""
    rows = url.with_normalized(read(spark, sf_dir, "pages").select("page_id", "url"), "url", "url_norm", "host").filter(~F.contains("host", F.lit("spam")))
    new = rows.groupBy("host").agg(F.min("page_id").alias("page_id"), F.min_by("url_norm", "page_id").alias("url_norm"))
    return identity.numbered(new, ["page_id"], 1).select("page_id", "url_norm", "host", "num")


# -- a tracker made of orders: cells of every kind that rules and checks tell apart -----------------------
_SENT = "(trim({0}) = '' OR lower(trim({0})) IN ('—', '-', 'n/a'))"
_STATES = {key.lower(): s.name for s in states.STATES for key in (s.name, *s.aliases)}
_STATE = "CASE lower(trim(status)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATES.items()) + " END"
_NEEDS = f"{_STATE} IN ({', '.join(repr(s.name) for s in states.STATES if s.requires_report)})"
_STATUS_CELLS = (*sorted(_STATES), "Queued", "Analyzed", "Weird", " Followup ")
_SOURCES = ("greenhouse", "Green House", "", "lever", "x1")
_RISK_CELLS, _CONFIDENCE_CELLS = ("—", "Low", "MEDIUM", " high ", "Extreme", "", "N/A", "Critical"), ("High", "low", "-", "Sure", "medium")
_pick = lambda cells, n: f"list_extract([{', '.join(repr(c) for c in cells)}], ((k // {n}) % {len(cells)} + 1)::BIGINT)"
_TRACKER = f"""t AS (SELECT k::BIGINT AS pos, CASE WHEN k % 50 = 7 THEN '0' WHEN k % 40 = 3 THEN 'x' || k WHEN k % 30 = 2 THEN (k - 1)::VARCHAR ELSE k::VARCHAR END AS num, CASE WHEN k % 17 = 0 THEN strftime(d, '%d/%m/%Y') ELSE strftime(d, '%Y-%m-%d') END AS date,
CASE WHEN k % 23 = 0 THEN ' ' WHEN k % 19 = 0 THEN '**' || p || '**' ELSE p || ' ' || (k // 4) END AS title, {_pick(_SOURCES, 3)} AS source, 'co ' || (k % 5) AS company, CASE WHEN k % 29 = 0 THEN 'a' || chr(1) ELSE 'Remote' END AS location,
CASE k % 6 WHEN 0 THEN '—' WHEN 1 THEN 'ftp://x/' || k WHEN 2 THEN '' ELSE 'https://Jobs.example.com/p/' || (k // 3) || '/?utm_source=x' END AS url, {_pick(_RISK_CELLS, 2)} AS risk, {_pick(_CONFIDENCE_CELLS, 5)} AS confidence, {_pick(_STATUS_CELLS, 1)} AS status,
CASE k % 5 WHEN 0 THEN '[' || k || '](../reports/' || k || '-x.md)' WHEN 1 THEN 'reports/' || k || '.md' WHEN 2 THEN 'see notes' ELSE '—' END AS report, CASE WHEN k % 31 = 0 THEN 'needle ' || k ELSE '' END AS notes FROM (SELECT o_orderkey AS k, o_orderdate AS d, o_orderpriority AS p FROM orders))"""
_KEY = "CASE WHEN url LIKE 'http%' THEN 'url:https://jobs.example.com/p/' || (pos // 3) ELSE 'title:' || " + _SLUG.format("title") + " || '|src:' || " + _SLUG.format("source") + " END"
_QUOTED = "', not \"' || {0} || '\"'"
_RULES = f"""list_filter([CASE WHEN NOT regexp_full_match(trim(num), '[0-9]+') OR regexp_full_match(trim(num), '0+') THEN 'num has to be a positive whole number' || {_QUOTED.format('trim(num)')} END,
CASE WHEN NOT regexp_full_match(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'date has to be YYYY-MM-DD' || {_QUOTED.format('date')} END, CASE WHEN trim(title) = '' THEN 'title is empty' END,
CASE WHEN NOT regexp_full_match(source, '[a-z0-9][a-z0-9-]*') THEN 'source has to be a slug in lower case' || {_QUOTED.format('source')} END,
CASE WHEN NOT {_SENT.format('url')} AND NOT regexp_matches(url, '^(?i)https?://') THEN 'url has to be http(s) or a sentinel' || {_QUOTED.format('url')} END,
CASE WHEN NOT {_SENT.format('risk')} AND lower(trim(risk)) NOT IN ('low', 'medium', 'high', 'critical') THEN 'risk has to be one of Low/Medium/High/Critical or a sentinel' || {_QUOTED.format('trim(risk)')} END,
CASE WHEN NOT {_SENT.format('confidence')} AND lower(trim(confidence)) NOT IN ('low', 'medium', 'high') THEN 'confidence has to be one of High/Medium/Low or a sentinel' || {_QUOTED.format('trim(confidence)')} END,
CASE WHEN {_STATE} IS NULL THEN 'status has to be a state or an alias' || {_QUOTED.format('trim(status)')} END,
CASE WHEN NOT {_SENT.format('report')} AND NOT regexp_full_match(report, '\\[[0-9]+\\]\\(.+\\)|[A-Za-z0-9._/-]+\\.md') THEN 'report has to be a sentinel, a link or a .md path' || {_QUOTED.format('report')} END], lambda x: x IS NOT NULL)"""
_CATALOG = states.Catalog()


def _tracker(spark, sf_dir):
    k, p = F.col("k"), F.col("p")
    pick = lambda cells, n: F.get(F.array(*map(F.lit, cells)), (F.floor(k / n) % len(cells)).cast("int"))
    text_of = lambda c: c.cast("string")
    num = F.when(k % 50 == 7, "0").when(k % 40 == 3, F.concat(F.lit("x"), text_of(k))).when(k % 30 == 2, text_of(k - 1)).otherwise(text_of(k))
    address = F.concat(F.lit("https://Jobs.example.com/p/"), text_of(F.floor(k / 3)), F.lit("/?utm_source=x"))
    cells = {
        "pos": k.cast("long"), "num": num, "date": F.when(k % 17 == 0, F.date_format("d", "dd/MM/yyyy")).otherwise(F.date_format("d", "yyyy-MM-dd")),
        "title": F.when(k % 23 == 0, " ").when(k % 19 == 0, F.concat(F.lit("**"), p, F.lit("**"))).otherwise(F.concat(p, F.lit(" "), text_of(F.floor(k / 4)))),
        "source": pick(_SOURCES, 3), "company": F.concat(F.lit("co "), text_of(k % 5)), "location": F.when(k % 29 == 0, "a\x01").otherwise("Remote"),
        "url": F.when(k % 6 == 0, text.DASH).when(k % 6 == 1, F.concat(F.lit("ftp://x/"), text_of(k))).when(k % 6 == 2, "").otherwise(address),
        "risk": pick(_RISK_CELLS, 2), "confidence": pick(_CONFIDENCE_CELLS, 5), "status": pick(_STATUS_CELLS, 1),
        "report": F.when(k % 5 == 0, F.concat(F.lit("["), text_of(k), F.lit("](../reports/"), text_of(k), F.lit("-x.md)"))).when(k % 5 == 1, F.concat(F.lit("reports/"), text_of(k), F.lit(".md"))).when(k % 5 == 2, "see notes").otherwise(text.DASH),
        "notes": F.when(k % 31 == 0, F.concat(F.lit("needle "), text_of(k))).otherwise(""), "raw": F.lit(None).cast("string"), "n_cells": F.lit(12), "malformed": F.lit(False),
    }
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("o_orderpriority").alias("p"))
    return orders.select(*(c.alias(name) for name, c in cells.items()))


@query(f"WITH {_TRACKER} SELECT pos, array_to_string({_RULES}, '; ') AS errors FROM t")
def row_validation(spark, sf_dir):
    return _tracker(spark, sf_dir).select("pos", F.array_join(tracker.validate(_CATALOG), "; ").alias("errors"))


@query(f"""WITH {_TRACKER} SELECT pos, trim(num) AS num, trim(title) AS title, lower(trim(source)) AS source, CASE WHEN {_SENT.format('url')} THEN '—' ELSE trim(url) END AS url,
CASE WHEN {_SENT.format('risk')} THEN '—' ELSE coalesce(CASE lower(trim(risk)) WHEN 'low' THEN 'Low' WHEN 'medium' THEN 'Medium' WHEN 'high' THEN 'High' WHEN 'critical' THEN 'Critical' END, trim(risk)) END AS risk,
CASE WHEN {_SENT.format('confidence')} THEN '—' ELSE coalesce(CASE lower(trim(confidence)) WHEN 'low' THEN 'Low' WHEN 'medium' THEN 'Medium' WHEN 'high' THEN 'High' END, trim(confidence)) END AS confidence, coalesce({_STATE}, trim(status)) AS status FROM t""")
def canonical_rows(spark, sf_dir):
    return tracker.canonical(_tracker(spark, sf_dir), _CATALOG).select("pos", "num", "title", "source", "url", "risk", "confidence", "status")


@query(f"WITH {_TRACKER}, k AS (SELECT pos, num, {_KEY} AS key FROM t), f AS (SELECT key, min(pos) AS first FROM k GROUP BY 1) SELECT k.pos, k.key, CASE WHEN k.pos > first THEN o.num END AS duplicate_of FROM k JOIN f ON k.key = f.key JOIN t o ON o.pos = first")
def tracker_identities(spark, sf_dir):
    return tracker.duplicates(_tracker(spark, sf_dir)).select("pos", "key", "duplicate_of")


@query(f"WITH {_TRACKER} SELECT pos, num FROM t WHERE status = 'Queued' AND lower(risk) = 'low' AND (contains(lower(title), 'urg') OR contains(lower(company), 'urg') OR contains(lower(notes), 'urg'))")
def tracker_find(spark, sf_dir):
    return tracker.find(_tracker(spark, sf_dir), _CATALOG, status="pending", risk="LOW", text="URG").select("pos", "num")


_LOG = "l AS (SELECT user_id::VARCHAR AS num, arg_max(CASE event_type WHEN 'click' THEN 'Queued' WHEN 'view' THEN 'Analyzed' WHEN 'purchase' THEN 'Cleared' ELSE 'Weird' END, event_id) AS logged FROM events GROUP BY 1)"
_FILES = "(SELECT pos FROM t WHERE pos % 5 = 0 AND pos % 4 <> 0)"


def _inputs(spark, sf_dir):
    """The tracker, a log made of events, and a report for some of the linked ones and for some that no row links."""
    rows = _tracker(spark, sf_dir)
    path = F.concat(F.lit("/w/reports/"), F.col("pos").cast("string"), F.lit("-x.md"))
    said = F.concat(F.lit("**Source:** "), F.when(F.col("pos") % 3 == 0, "greenhouse").otherwise("lever"), F.lit("\n"), F.when(F.col("pos") % 7 == 0, "see jds/a.pdf").when(F.col("pos") % 7 == 1, "see b.txt").when(F.col("pos") % 7 == 2, F.lit(reports.SECTIONS[-1])).otherwise(""))
    files = rows.filter("pos % 5 in (0, 3) and pos % 4 <> 0").select(path.alias("path"), F.substring_index(path, "/", -1).alias("name"), said.alias("text"))
    state = F.when(F.col("event_type") == "click", "Queued").when(F.col("event_type") == "view", "Analyzed").when(F.col("event_type") == "purchase", "Cleared").otherwise("Weird")
    line = F.concat_ws("\t", F.lit("2026-01-01T00:00:00.000Z"), F.lit("-"), state, F.lit("cli"), F.col("user_id").cast("string"), F.lit(""))
    log = read(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("pos"), line.alias("line"))
    empty = spark.createDataFrame([], "name string, errors array<string>, bound boolean, " + ", ".join(f"{c} string" for c in markdown.COLUMNS))
    held = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_nationkey").cast("long").alias("start"), (F.col("n_nationkey") + 1).cast("long").alias("end"), F.when(F.col("n_nationkey") % 3 == 0, "2026-01-01T00:00:00.000Z").when(F.col("n_nationkey") % 3 == 1, "").otherwise("soon").alias("timestamp"))
    entries = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entry_pos"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "lever").when(F.col("s_suppkey") % 3 == 0, "nobody").alias("integration"))
    captures = spark.createDataFrame([("a.pdf",)], "name string")
    return integrity.Inputs(rows, "/w/data", files, empty, log, held, entries, captures, tuple(jobboard.SEEDS), _CATALOG)


_BOLD = " + ".join(f"(regexp_matches({c}, '\\*\\*[^*]+\\*\\*'))::INT" for c in ("num", "date", "title", "source", "company", "location", "url", "risk", "confidence", "status", "report", "notes"))
_COUNTS = {
    1: ("error", f"SELECT pos FROM t WHERE {_STATE} IS NULL OR {_STATE} <> status"),
    2: ("error", f"SELECT pos FROM (SELECT pos, row_number() OVER (PARTITION BY {_KEY} ORDER BY pos) AS n FROM t) WHERE n > 1"),
    3: ("error", f"SELECT pos FROM t WHERE CASE WHEN pos % 5 IN (0, 1) THEN NOT (pos % 5 = 0 AND pos % 4 <> 0) ELSE coalesce({_NEEDS}, false) END"),
    4: ("error", f"SELECT pos FROM t WHERE NOT {_SENT.format('risk')} AND lower(trim(risk)) NOT IN ('low', 'medium', 'high', 'critical') UNION ALL SELECT pos FROM t WHERE NOT {_SENT.format('confidence')} AND lower(trim(confidence)) NOT IN ('low', 'medium', 'high')"),
    5: ("error", f"SELECT unnest({_RULES}) FROM t"),
    6: ("error", "SELECT 1 WHERE false"),
    7: ("error", f"SELECT unnest(range({_BOLD})) FROM t"),
    8: ("warn", "SELECT 1 FROM nation WHERE n_nationkey % 3 <> 2"),
    9: ("error", "SELECT pos FROM t WHERE false"),
    10: ("warn", "SELECT pos FROM t WHERE pos % 5 = 3 AND pos % 4 <> 0"),
    11: ("error", "SELECT pos FROM t WHERE source = '' UNION ALL SELECT pos FROM t WHERE pos % 5 = 0 AND pos % 4 <> 0 AND source <> CASE WHEN pos % 3 = 0 THEN 'greenhouse' ELSE 'lever' END"),
    12: ("error", "SELECT pos FROM (SELECT pos, row_number() OVER (PARTITION BY num ORDER BY pos) AS n FROM t) WHERE n > 1"),
    13: ("error", "SELECT t.pos FROM t JOIN l ON t.num = l.num WHERE status <> logged UNION ALL SELECT 1 FROM l WHERE num NOT IN (SELECT num FROM t)"),
    14: ("error", "SELECT 1 FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')"),
    15: ("error", "SELECT 1 FROM supplier WHERE s_suppkey % 2 <> 0 AND s_suppkey % 3 = 0"),
    16: ("error", "SELECT pos FROM t WHERE contains(location, chr(1))"),
    17: ("error", "SELECT pos FROM t WHERE pos % 5 IN (0, 3) AND pos % 4 <> 0 AND pos % 7 NOT IN (0, 2)"),
    18: ("error", "SELECT pos FROM t WHERE pos % 5 IN (0, 3) AND pos % 4 <> 0"),
}


@query(f"WITH {_TRACKER}, {_LOG} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS check_id, CASE WHEN count(*) > 0 THEN '{level}' ELSE 'ok' END AS level, count(*) AS n FROM ({sql})" for k, (level, sql) in _COUNTS.items()))
def integrity_checks(spark, sf_dir):
    """All eighteen checks over the tracker, its log and its reports."""
    found = integrity.levels_of(integrity.findings(_inputs(spark, sf_dir)))
    return found.select(F.col("check_id").cast("long").alias("check_id"), "level", F.col("n").cast("long").alias("n"))


@query(f"WITH {_TRACKER} SELECT pos, 'row ' || num || ': ' || CASE WHEN {_STATE} IS NULL THEN 'unknown status \"' || status || '\"' ELSE 'status \"' || status || '\" is to be ' || {_STATE} END AS message FROM t WHERE {_STATE} IS NULL OR {_STATE} <> status")
def check_statuses(spark, sf_dir):
    return integrity.statuses(_inputs(spark, sf_dir)).select(F.col("ord").alias("pos"), "message")


@query(f"WITH {_TRACKER}, {_LOG} SELECT coalesce(t.num, l.num) AS num, CASE WHEN t.num IS NULL THEN 'warn' ELSE 'error' END AS level FROM t FULL JOIN l ON t.num = l.num WHERE t.num IS NULL OR (l.num IS NOT NULL AND status <> logged)")
def check_log_sync(spark, sf_dir):
    rows = integrity.sync(_inputs(spark, sf_dir))
    return rows.select(F.regexp_extract("message", "row ([^:,]+)[:,]", 1).alias("num"), "level")


@query(f"""WITH {_TRACKER}, a AS (SELECT *, {_KEY} AS key, lpad(pos::VARCHAR, 9, '0') || '.tsv' AS name FROM t WHERE len({_RULES}) = 0), known AS (SELECT key, arg_max(num, pos) AS num FROM a WHERE pos % 2 = 0 GROUP BY 1),
new AS (SELECT *, first_value(num) OVER w AS first, row_number() OVER w AS n FROM a WHERE pos % 2 = 1 WINDOW w AS (PARTITION BY key ORDER BY name))
SELECT new.name, CASE WHEN known.num IS NOT NULL THEN known.num WHEN n > 1 THEN first END AS duplicate_of FROM new LEFT JOIN known ON new.key = known.key""")
def merge_additions(spark, sf_dir):
    """Odd rows that break no rule are merged into the even ones."""
    rows = _tracker(spark, sf_dir).filter(F.size(tracker.validate(_CATALOG)) == 0)
    new = rows.filter("pos % 2 = 1").withColumns({"name": F.concat(F.lpad(F.col("pos").cast("string"), 9, "0"), F.lit(".tsv")), "errors": F.array().cast("array<string>"), "bound": F.lit(True)})
    done = merge.merged(rows.filter("pos % 2 = 0"), new, _CATALOG)
    return done.accepted.select("name", F.lit(None).cast("string").alias("duplicate_of")).unionByName(done.skipped.select("name", "duplicate_of"))


@query(f"WITH {_TRACKER} SELECT pos, CASE pos % 5 WHEN 0 THEN '../reports/' || pos || '-x.md' WHEN 1 THEN 'reports/' || pos || '.md' END AS target, CASE pos % 5 WHEN 0 THEN '/w/reports/' || pos || '-x.md' WHEN 1 THEN '/w/data/reports/' || pos || '.md' END AS path, CASE WHEN pos % 5 = 0 AND pos % 4 <> 0 THEN '[' || pos || '](../reports/' || pos || '-x.md)' ELSE report END AS report FROM t")
def report_links(spark, sf_dir):
    x = _inputs(spark, sf_dir)
    rows = x.rows.withColumn("target", tracker.report_target(F.col("report"))).withColumn("path", tracker.resolved_path(F.col("target"), "/w/data"))
    return tracker.rewritten_links(rows, x.reports, "/w/data", "/w").select("pos", "target", "path", "report")


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN (o_orderkey // 5) % 2 = 0 ELSE false END AS blocked FROM orders")
def address_guard(spark, sf_dir):
    """Addresses of both families, and host names, which are not blocked as such."""
    k = F.col("o_orderkey")
    mapped = F.when(F.floor(k / 5) % 2 == 0, "::ffff:10.0.0.1").otherwise("::ffff:8.8.8.8")
    address = F.when(k % 5 == 0, F.concat(F.lit("fc00::"), F.hex(k))).when(k % 5 == 1, F.concat(F.lit("2a00::"), F.hex(k))).when(k % 5 == 2, F.concat(F.lit("169.254."), (k % 256).cast("string"), F.lit(".1"))).when(k % 5 == 3, mapped).otherwise("host.example")
    return read(spark, sf_dir, "orders").select("o_orderkey", net.blocked_address(address).alias("blocked"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'https://x.example/' || doc_id WHEN doc_id % 3 = 1 THEN 'http://y.example/' || doc_id END AS url, 'lever' AS source, CASE WHEN doc_id % 4 = 0 THEN 'jds/d-' || doc_id || '.pdf' END AS capture FROM documents")
def report_fields(spark, sf_dir):
    """Header fields, line fields and captured files that are put in front of each text; texts themselves may hold none of them."""
    k = F.col("doc_id").cast("string")
    head = F.concat(F.lit("**Source:** lever x\n"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("file jds/d-"), k, F.lit(".pdf\n"))).otherwise(""), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("**URL:** https://x.example/"), k)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("**URL:** none\nurl: 'http://y.example/"), k, F.lit("'"))).otherwise("**URL:** -"), F.lit("\n"))
    rows = read(spark, sf_dir, "documents").select("doc_id", head.alias("text"))
    return rows.select("doc_id", reports.source_url(F.col("text")).alias("url"), reports.header_field(F.col("text"), "Source").alias("source"), reports.capture(F.col("text")).alias("capture"))

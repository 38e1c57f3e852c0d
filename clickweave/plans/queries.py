"""The registered queries: each applies an operator to whole tables. Times are returned as text, arrays joined, so that any
engine can compare them; the SQL beside each query is independent of the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scrub, validation
from ..operators import curated, funnel, journeys, live, maintenance, pages, sessions
from ..sources import events as sources
from ..sources.scratch import exists, scratch_path
from ..streaming import jobs, sinks, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF = 1705276800000  # 2024-01-15T00:00:00Z
DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.table_events(table(spark, sf_dir, "events"))


def good_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_events(spark, sf_dir).filter(F.col("eventType") != "ERROR")


def flat(df: DataFrame) -> DataFrame:
    """Timestamps as text with milliseconds, arrays of text joined by |."""
    out = {}
    for c, kind in df.dtypes:
        if kind == "timestamp":
            out[c] = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
        elif kind == "array<string>":
            out[c] = F.array_join(c, "|")
    return df.withColumns(out) if out else df


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


#: The adapter over the table `events`, as SQL: ev has all events, va those that aren't errors.
EV = r"""
raw AS (SELECT *, regexp_extract(props, '(\d+)', 1)::INT AS k FROM events),
ev AS (SELECT event_id, user_id, k, 'evt-' || event_id AS eventId, 'user-' || user_id AS userId, 'sess-' || user_id || '-' || strftime(ts, '%Y%m%d') AS sessionId,
  CASE event_type WHEN 'view' THEN 'PAGE_VIEW' WHEN 'click' THEN 'CLICK' WHEN 'purchase' THEN 'SCROLL' WHEN 'signup' THEN 'HOVER' ELSE 'ERROR' END AS eventType,
  CASE WHEN k % 11 <> 0 THEN 'button#b' || (k % 7) END AS targetElement, 'https://shop.example/p/' || (k % 20) AS pageUrl,
  CASE WHEN k % 3 <> 0 THEN 'https://ref.example/' || (k % 5) END AS referrerUrl, ts, epoch_us(ts) // 1000 AS ms, k * 10 AS x, k * 5 AS y, k::DOUBLE / 80 AS scrollDepth,
  floor(value * 100)::BIGINT AS durationMs, 'Mozilla/5.0 (' || CASE WHEN user_id % 2 = 0 THEN 'Windows NT 10.0' ELSE 'iPhone' END || ') Chrome/120.0.0.0' AS userAgent FROM raw),
va AS (SELECT * FROM ev WHERE eventType <> 'ERROR')"""


def text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%g')"


def sessions_cte(gap: str, rows: str = "va", name: str = "ses") -> str:
    """Session aggregates with the columns of sessions.session_aggregates and time columns as timestamps."""
    return f"""
{name}_marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER o <= INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM {rows} WINDOW o AS (PARTITION BY sessionId, userId ORDER BY ts, event_id)),
{name}_numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY sessionId, userId ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM {name}_marked),
{name} AS (SELECT *, nPages = 1 AND durationMs < 10000 AS bounced FROM (SELECT sessionId, userId, min(ts) AS windowStart, max(ts) + INTERVAL {gap} AS windowEnd,
  epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS durationMs, count(*) FILTER (eventType = 'PAGE_VIEW') AS pageViewCount, count(*) FILTER (eventType = 'CLICK') AS clickCount,
  count(*) FILTER (eventType = 'SCROLL') AS scrollEvents, list_sort(list(DISTINCT pageUrl)) AS pages, count(DISTINCT pageUrl) AS nPages,
  first(pageUrl ORDER BY ts, eventId) AS entryPage, last(pageUrl ORDER BY ts, eventId) AS exitPage, count(*) AS eventCount,
  min(CASE WHEN userAgent LIKE '%iPhone%' THEN 'mobile' ELSE 'desktop' END) AS devices, 'Chrome' AS browsers
  FROM {name}_numbered GROUP BY sessionId, userId, s))"""


SESSION_COLUMNS = f"""sessionId, userId, {text("windowStart")} AS windowStart, {text("windowEnd")} AS windowEnd, durationMs, pageViewCount, clickCount, scrollEvents,
  array_to_string(pages, '|') AS uniquePages, entryPage, exitPage, bounced, sessionId || '_' || {text("windowStart")} AS _compositeKey"""


def pages_cte(width: str) -> str:
    return f"""
pm AS (SELECT pageUrl, time_bucket(INTERVAL {width}, ts) AS windowStart, time_bucket(INTERVAL {width}, ts) + INTERVAL {width} AS windowEnd, count(*) FILTER (eventType = 'PAGE_VIEW') AS totalViews,
  count(DISTINCT userId) AS uniqueVisitors, count(*) FILTER (eventType = 'CLICK') AS clickCount, avg(scrollDepth) FILTER (eventType = 'SCROLL') AS avgScrollDepth FROM va GROUP BY ALL)"""


PAGE_COLUMNS = f"""pageUrl, {text("windowStart")} AS windowStart, {text("windowEnd")} AS windowEnd, totalViews, uniqueVisitors, clickCount, round(avgScrollDepth, 6) AS avgScrollDepth,
  pageUrl || '_' || {text("windowStart")} AS _compositeKey"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- sources and parsing -------------------------------------------------------------------------------------------


@query("io2_parse_json", f"WITH {EV} SELECT eventId, sessionId, eventType, pageUrl, referrerUrl, ms AS timestamp, x, scrollDepth, durationMs FROM ev")
def io2_parse_json(spark, sf_dir):
    """Events written as JSON and parsed back."""
    parsed = sources.parse_json(sinks.keyed_json(all_events(spark, sf_dir)))
    return parsed.select("eventId", "sessionId", "eventType", "pageUrl", "referrerUrl", "timestamp", "metadata.x", "metadata.scrollDepth", "metadata.durationMs")


@query("io3_event_time", f"WITH {EV} SELECT eventId, {text('make_timestamp(ms * 1000)')} AS ts, {text('make_timestamp((ms - ms % 1000) * 1000)')} AS tsSeconds FROM ev")
def io3_event_time(spark, sf_dir):
    ev = all_events(spark, sf_dir).drop("ts")
    both = sources.with_event_time(sources.with_event_time(ev, whole_seconds=True).withColumnRenamed("ts", "tsSeconds"))
    return flat(both.select("eventId", "ts", "tsSeconds"))


@query("io5_json_batches", f"WITH {EV} SELECT eventId, sessionId, (row_number() OVER (PARTITION BY sessionId ORDER BY eventId) - 1)::INT AS index FROM ev")
def io5_json_batches(spark, sf_dir):
    """The events of each session as one JSON array, parsed into indexed rows."""
    arrays = all_events(spark, sf_dir).drop("ts").groupBy("sessionId").agg(F.to_json(F.sort_array(F.collect_list(F.struct("eventId", "sessionId", "eventType", "timestamp")))).alias("value"))
    return sources.parse_json_batches(arrays).select("eventId", "sessionId", "index")


@query("io6_keyed_json", f"""WITH {EV} SELECT sessionId AS key, eventId, userId, eventType, pageUrl, referrerUrl, targetElement, ms::VARCHAR AS timestamp, userAgent, x::VARCHAR AS x, y::VARCHAR AS y, durationMs::VARCHAR AS durationMs,
  'item ' || k AS elementText, '1.0' AS schemaVersion, NULL::VARCHAR AS deviceType FROM ev""")
def io6_keyed_json(spark, sf_dir):
    """Key and every value of the JSON, as text; what is null isn't in it."""
    top = ("eventId", "userId", "eventType", "pageUrl", "referrerUrl", "targetElement", "timestamp", "userAgent", "schemaVersion")
    paths = {c: f"$.{c}" for c in top} | {c: f"$.metadata.{c}" for c in ("x", "y", "durationMs", "elementText", "deviceType")}
    return sinks.keyed_json(all_events(spark, sf_dir)).select("key", *(F.get_json_object("value", path).alias(c) for c, path in paths.items()))


_HOURS = "SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour"


@query("io7_archive_hours", f"WITH {EV} {_HOURS}, count(*) AS n FROM ev GROUP BY ALL")
def io7_archive_hours(spark, sf_dir):
    return sinks.with_partitions(all_events(spark, sf_dir)).groupBy("year", "month", "day", "hour").agg(F.count("*").alias("n"))


@query("io11_archive_range", f"WITH {EV} SELECT eventType, count(*) AS n FROM ev WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts <= TIMESTAMP '2024-01-12 18:00:00' GROUP BY eventType")
def io11_archive_range(spark, sf_dir):
    """Writes the lake by day and hour, reads a range of it with pruned folders, and counts by type."""
    path = scratch_path(spark, "lake")
    sinks.archive(all_events(spark, sf_dir), path)
    start, end = (dt.datetime(2024, 1, d, h, tzinfo=dt.UTC) for d, h in ((10, 6), (12, 18)))
    rows = spark.read.parquet(path).filter(maintenance.partition_predicate(start, end)).filter(F.col("ts").between(F.lit(start), F.lit(end)))
    return rows.groupBy("eventType").agg(F.count("*").alias("n"))


@query("io8_keyed_merge", f"WITH {EV}, {pages_cte('1 DAY')} SELECT pageUrl, {text('windowStart')} AS windowStart, totalViews FROM pm")
def io8_keyed_merge(spark, sf_dir):
    """Page metrics of the first half, then of all events, merged by key: later rows replace earlier ones; replays of either batch change nothing."""
    ev, target = good_events(spark, sf_dir), sinks.KeyedTable(spark, scratch_path(spark, "merge"))
    half = pages.page_metrics(ev.filter(F.col("timestamp") < AS_OF - 12 * 3_600_000), "1 day")
    everything = pages.page_metrics(ev, "1 day")
    for batch, batch_id in ((half, 0), (everything, 1), (half, 1), (half, 0)):
        target.merge(batch, batch_id)
    return flat(target.read().select("pageUrl", "windowStart", "totalViews"))


# --- validation ----------------------------------------------------------------------------------------------------

V_AS_OF = AS_OF + DAY_MS
_V = f"""{EV}, checked AS (SELECT *, list_filter([
  CASE WHEN eventType = 'ERROR' THEN 'eventType is unknown' END,
  CASE WHEN ms > {V_AS_OF} + 300000 THEN 'timestamp is in the future' WHEN ms < {V_AS_OF} - 86400000 THEN 'timestamp is too old' END,
  CASE WHEN eventType = 'CLICK' AND targetElement IS NULL THEN 'CLICK needs targetElement' END,
  CASE WHEN eventType = 'SCROLL' AND scrollDepth > 1 THEN 'scrollDepth must lie in 0 to 1' END,
  CASE WHEN eventType = 'HOVER' AND targetElement IS NULL THEN 'HOVER needs targetElement' END], lambda m: m IS NOT NULL) AS errors FROM ev)"""


def checked_events(spark, sf_dir):
    return validation.validate(all_events(spark, sf_dir), V_AS_OF)


@query("v_all_rules", f"WITH {_V} SELECT eventId, array_to_string(errors, '|') AS errors FROM checked")
def v_all_rules(spark, sf_dir):
    return flat(checked_events(spark, sf_dir).select("eventId", "errors"))


#: What an otherwise valid event has instead (SQL), case by case, and what validation says of it.
_BROKEN: list[tuple[dict[str, str], str]] = [
    ({}, ""),
    ({"eventId": "NULL"}, "eventId is required"),
    ({"eventId": "'  '"}, "eventId is required"),
    ({"userId": "NULL"}, "userId is required"),
    ({"sessionId": "''"}, "sessionId is required"),
    ({"eventType": "NULL"}, "eventType is required"),
    ({"eventType": "'SWIPE'"}, "eventType is unknown"),
    ({"pageUrl": "NULL"}, "pageUrl is required"),
    ({"timestamp": "NULL"}, "timestamp is required"),
    ({"timestamp": "0"}, "timestamp must be positive"),
    ({"timestamp": f"{V_AS_OF + 300_001}"}, "timestamp is in the future"),
    ({"timestamp": f"{V_AS_OF + 300_000}"}, ""),
    ({"timestamp": f"{V_AS_OF - DAY_MS - 1}"}, "timestamp is too old"),
    ({"timestamp": f"{V_AS_OF - DAY_MS}"}, ""),
    ({"eventId": "repeat('x', 256)"}, "eventId is longer than 255"),
    ({"userId": "repeat('x', 256)"}, "userId is longer than 255"),
    ({"sessionId": "repeat('x', 256)"}, "sessionId is longer than 255"),
    ({"pageUrl": "rpad('https://e.com/', 2049, 'x')"}, "pageUrl is longer than 2048"),
    ({"pageUrl": "rpad('https://e.com/', 2048, 'x')"}, ""),
    ({"referrerUrl": "rpad('https://e.com/', 2049, 'x')"}, "referrerUrl is longer than 2048"),
    ({"targetElement": "repeat('x', 513)"}, "targetElement is longer than 512"),
    ({"userAgent": "repeat('x', 8193)"}, "userAgent is longer than 8192"),
    ({"userAgent": "repeat('x', 8192)"}, ""),
    ({"elementText": "repeat('x', 1025)"}, "elementText is longer than 1024"),
    ({"pageUrl": "'ftp://example.com/x'"}, "pageUrl must use http or https"),
    ({"pageUrl": "'www.example.com/x'"}, "pageUrl has no scheme"),
    ({"pageUrl": "'http://exa mple.com'"}, "pageUrl is not a valid URL"),
    ({"referrerUrl": "'ftp://example.com/x'"}, "referrerUrl must use http or https"),
    ({"referrerUrl": "'example.com'"}, "referrerUrl has no scheme"),
    ({"referrerUrl": "''"}, ""),
    ({"targetElement": "'<ScRiPt>x'"}, "targetElement holds markup or script"),
    ({"targetElement": "'a onclick=b'"}, "targetElement holds markup or script"),
    ({"pageUrl": "'https://e.com/?q=javascript:x'"}, "pageUrl holds markup or script"),
    ({"elementText": "'an <iframe src=x>'"}, "elementText holds markup or script"),
    ({"sessionId": "userId"}, "sessionId equals userId"),
    ({"elementText": "'Enter Password'"}, "elementText names personal data"),
    ({"elementText": "'Credit-Card number'"}, "elementText names personal data"),
    ({"elementText": "'spinning'"}, ""),
    ({"userAgent": "'Mozilla/5.0 (192.168.0.1)'"}, "userAgent holds an IP address"),
    ({"eventType": "'CLICK'", "targetElement": "NULL"}, "CLICK needs targetElement"),
    ({"eventType": "'CLICK'", "y": "NULL"}, "CLICK needs x and y"),
    ({"eventType": "'CLICK'"}, ""),
    ({"eventType": "'SCROLL'", "scrollDepth": "NULL"}, "SCROLL needs scrollDepth"),
    ({"eventType": "'SCROLL'", "scrollDepth": "1.1"}, "scrollDepth must lie in 0 to 1"),
    ({"eventType": "'SCROLL'", "scrollDepth": "1.0"}, ""),
    ({"eventType": "'HOVER'", "targetElement": "' '"}, "HOVER needs targetElement"),
    ({"eventType": "'HOVER'", "durationMs": "NULL"}, "HOVER needs durationMs"),
    ({"eventType": "'HOVER'"}, ""),
    ({"eventType": "'SWIPE'", "userId": "NULL"}, "userId is required|eventType is unknown"),
    ({"userId": "'\\t \\n'"}, "userId is required"),
    ({"pageUrl": "'\\r\\n'"}, "pageUrl is required"),
    ({"eventType": "'CLICK'", "targetElement": "'\\t'"}, "CLICK needs targetElement"),
    ({"pageUrl": "'HTTP://e.com/x'"}, "pageUrl must use http or https"),
    ({"referrerUrl": "'Https://e.com/x'"}, "referrerUrl must use http or https"),
]


@query("v_each_rule", f"SELECT event_id, ({[m for _, m in _BROKEN]!r}::VARCHAR[])[1 + event_id % {len(_BROKEN)}] AS errors FROM events")
def v_each_rule(spark, sf_dir):
    """Every event, made valid and then broken in the way of its number: each rule meets events on both of its sides."""
    ev = all_events(spark, sf_dir).withColumn("event_id", F.substring("eventId", 5, 20).cast("long"))
    valid = {"eventType": F.lit("PAGE_VIEW"), "timestamp": F.lit(V_AS_OF), "targetElement": F.lit("button"), "referrerUrl": F.lit(None).cast("string")}
    inner = {"x": F.lit(1), "y": F.lit(2), "scrollDepth": F.lit(0.5), "elementText": F.lit("item"), "durationMs": F.lit(5)}
    case = F.pmod("event_id", F.lit(len(_BROKEN)))

    def chosen(name: str, otherwise: Column) -> Column:
        for k, (change, _) in enumerate(_BROKEN):
            if name in change:
                otherwise = F.when(case == k, F.expr(change[name])).otherwise(otherwise)
        return otherwise

    metadata = F.col("metadata")
    for name, value in inner.items():
        metadata = metadata.withField(name, chosen(name, value).cast(ev.schema["metadata"].dataType[name].dataType))
    top = {c: chosen(c, valid.get(c, F.col(c))).cast(ev.schema[c].dataType) for c in ("eventId", "userId", "sessionId", "eventType", "pageUrl", "referrerUrl", "timestamp", "targetElement", "userAgent")}
    broken = ev.select("event_id", *(value.alias(c) for c, value in top.items()), metadata.alias("metadata"))
    return flat(validation.validate(broken, V_AS_OF).select("event_id", "errors"))


@query("v18_url_rules", """
WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'ftp://files.example/' || page_id WHEN 2 THEN 'www.example.com/' || page_id ELSE 'http://bad host/' || page_id END AS u FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'url must use http or https' WHEN 2 THEN 'url has no scheme' WHEN 3 THEN 'url is not a valid URL' END AS error FROM u""")
def v18_url_rules(spark, sf_dir):
    kind = F.col("page_id") % 4
    url = F.when(kind == 0, F.col("url")).when(kind == 1, F.concat(F.lit("ftp://files.example/"), "page_id")).when(kind == 2, F.concat(F.lit("www.example.com/"), "page_id")).otherwise(F.concat(F.lit("http://bad host/"), "page_id"))
    return table(spark, sf_dir, "pages").withColumn("url", url).select("page_id", validation.url_error("url").alias("error"))


_EDGE = r"($|[^\p{L}\p{N}_])"


_TEXTS = "CASE doc_id % 5 WHEN 0 THEN 'Enter Password: ' || text WHEN 1 THEN text || ' SSN' WHEN 2 THEN text || ' at 10.0.0.' || doc_id % 256 WHEN 3 THEN 'passwords ' || text ELSE text END"


@query("v24_v25_text_rules", rf"""WITH t AS (SELECT doc_id, {_TEXTS} AS text FROM documents)
SELECT doc_id, regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])(password|passwd|pwd|ssn|social.?security|credit.?card|cvv|pin){_EDGE}') AS pii,
  regexp_matches(text, '(^|[^/\p{{L}}\p{{N}}_])(\d{{1,3}}\.){{3}}\d{{1,3}}{_EDGE}') AS ip FROM t""")
def v24_v25_text_rules(spark, sf_dir):
    """The rules for personal data and addresses over whole texts, to some of which a case of them was added."""
    text = F.expr(_TEXTS)
    return table(spark, sf_dir, "documents").select("doc_id", text.rlike(validation.PII).alias("pii"), text.rlike(validation.IPV4).alias("ip"))


#: Batches of two kinds: the events of a session, and page views by a sixteenth of the users (over 100 but in the smallest table), each judged at its own time.
_JUDGED = f"""{EV}, own AS (SELECT *, eventType = 'ERROR' OR (eventType IN ('CLICK', 'HOVER') AND targetElement IS NULL) OR (eventType = 'SCROLL' AND scrollDepth > 1) AS broken FROM ev),
dealt AS (SELECT sessionId AS batch_id, * FROM own UNION ALL SELECT 'views-' || user_id % 16, * FROM own WHERE eventType = 'PAGE_VIEW'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ms, event_id) - 1 AS i FROM dealt)"""


@query("v33_batches", f"WITH {_JUDGED} SELECT batch_id, count(*) AS n, (min(i) FILTER (broken))::INT AS first_invalid, min(i) FILTER (broken) IS NULL AND count(*) <= 100 AS accepted FROM numbered GROUP BY batch_id")
def v33_batches(spark, sf_dir):
    from pyspark.sql import Window

    rows = validation.validate(all_events(spark, sf_dir), F.col("timestamp"))
    views = F.concat(F.lit("views-"), F.substring("userId", 6, 20).cast("long") % 16)
    rows = rows.withColumn("batch_id", F.col("sessionId")).union(rows.filter(sessions.is_type("PAGE_VIEW")).withColumn("batch_id", views))
    number = F.row_number().over(Window.partitionBy("batch_id").orderBy("timestamp", F.substring("eventId", 5, 20).cast("long"))) - 1
    return validation.judge_batches(rows.withColumn("index", number))


@query("v34_reasons", f"WITH {_V} SELECT reason, count(*) AS n FROM (SELECT unnest(errors) AS reason FROM checked) GROUP BY reason")
def v34_reasons(spark, sf_dir):
    return validation.reason_counts(checked_events(spark, sf_dir))


@query("v35_has_keys", "SELECT event_id FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0")
def v35_has_keys(spark, sf_dir):
    """Events of which some were left without either key."""
    ev = all_events(spark, sf_dir).withColumn("event_id", F.substring("eventId", 5, 20).cast("long"))
    keys = {c: F.when(F.col("event_id") % n != 0, F.col(c)) for c, n in (("eventId", 3), ("sessionId", 5))}
    return ev.withColumns(keys).filter(validation.has_keys()).select("event_id")


@query("v36_acceptance", f"WITH {_V} SELECT count(*) AS n, count(*) FILTER (len(errors) = 0) AS accepted, round(avg(CASE WHEN len(errors) = 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM checked")
def v36_acceptance(spark, sf_dir):
    return rounded(validation.acceptance_rate(checked_events(spark, sf_dir)), "rate")


# --- scrubbing -----------------------------------------------------------------------------------------------------


@query("p1_p2_addresses", r"""WITH e AS (SELECT event_id, user_id % 300 AS u, regexp_extract(props, '(\d+)', 1)::INT AS k FROM events)
SELECT event_id, u || '.' || k || '.7.0' AS four, CASE k % 4 WHEN 0 THEN '0.0.0.0' WHEN 1 THEN '2001:db8:' || k || '::' WHEN 2 THEN '::' ELSE '0.0.0.0' END AS other FROM e""")
def p1_p2_addresses(spark, sf_dir):
    k, u = F.regexp_extract("props", r"(\d+)", 1).cast("int"), F.col("user_id") % 300
    four = F.concat_ws(".", u.cast("string"), k.cast("string"), F.lit("7"), (k * 2).cast("string"))
    other = F.when(k % 4 == 0, F.concat_ws(".", u.cast("string"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("2001:db8:"), k.cast("string"), F.lit(":1:2"))).when(k % 4 == 2, F.lit("a:b")).otherwise(F.lit(" "))
    return table(spark, sf_dir, "events").select("event_id", scrub.anonymize_ip(four).alias("four"), scrub.anonymize_ip(other).alias("other"))


@query("p3_p4_ids", f"WITH {EV} SELECT eventId, CASE WHEN length(k::VARCHAR) <= 4 THEN '***' END AS short, left(userId, 4) || '***' AS masked, sha256('s1' || userId) AS hashed FROM ev")
def p3_p4_ids(spark, sf_dir):
    ev = all_events(spark, sf_dir)
    return ev.select("eventId", scrub.mask_id((F.col("metadata.x") / 10).cast("int").cast("string")).alias("short"), scrub.mask_id(F.col("userId")).alias("masked"), scrub.hash_id(F.col("userId"), "s1").alias("hashed"))


@query("p5_strip_markup", "SELECT page_id, substr(regexp_replace(html, '<[^>]*>', '', 'g'), 1, 200) AS stripped FROM pages")
def p5_strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scrub.strip_markup(F.col("html")).alias("stripped"))


_ELEMENTS = "CASE event_id % 7 WHEN 0 THEN 'input#Password-' || event_id WHEN 1 THEN 'CREDITCARD' WHEN 2 THEN 'field.ssn' WHEN 3 THEN 'the-secret' WHEN 4 THEN NULL ELSE 'button#b' || event_id END"


@query("p6_sensitive", f"SELECT event_id, event_id % 7 < 4 AS sensitive FROM events UNION ALL SELECT doc_id, regexp_matches(lower(text), 'password|creditcard|ssn|secret') FROM documents")
def p6_sensitive(spark, sf_dir):
    """Elements of events and whole texts."""
    elements = table(spark, sf_dir, "events").select("event_id", scrub.is_sensitive(F.expr(_ELEMENTS)).alias("sensitive"))
    return elements.union(table(spark, sf_dir, "documents").select("doc_id", scrub.is_sensitive(F.col("text"))))


@query("p7_p8_urls", """WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '<script>x</script>&onload=javascript:go' WHEN 1 THEN 'mailto:<b>''"' || page_id ELSE url END AS u FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(u, '<script>x</script>&onload=javascript:go$', '&go') WHEN 1 THEN 'mailto:b' || page_id ELSE u END AS safe, CASE WHEN page_id % 3 <> 1 THEN u END AS referrer FROM u""")
def p7_p8_urls(spark, sf_dir):
    kind = F.col("page_id") % 3
    url = F.when(kind == 0, F.concat("url", F.lit("<script>x</script>&onload=javascript:go"))).when(kind == 1, F.concat(F.lit("mailto:<b>'\""), "page_id")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", scrub.sanitize_url(url).alias("safe"), scrub.http_only(url).alias("referrer"))


@query("p9_scrub", f"WITH {EV} SELECT eventId, targetElement, pageUrl, referrerUrl, sha256('s1' || userId) AS userId, least(1.0, greatest(0.0, scrollDepth)) AS depth FROM ev")
def p9_scrub(spark, sf_dir):
    """The whole scrub projection, with clamped depths and hashed users."""
    return scrub.scrub(all_events(spark, sf_dir), salt="s1").select("eventId", "targetElement", "pageUrl", "referrerUrl", "userId", F.col("metadata.scrollDepth").alias("depth"))


@query("p10_debounce", f"""WITH {EV} SELECT eventId FROM (SELECT *, lead(ms) OVER (PARTITION BY userId, eventType ORDER BY ms, eventId) AS after FROM ev)
WHERE eventType <> 'CLICK' OR after IS NULL OR after - ms >= 21600000""")
def p10_debounce(spark, sf_dir):
    """Click bursts of a user; the gap is 6 hours, for this table has none of 200 ms."""
    return scrub.debounce(all_events(spark, sf_dir), keys=("userId",), gap_ms=21_600_000).select("eventId")


@query("p11_sessions", f"""WITH {EV}, marked AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY userId ORDER BY ms, eventId) < 1800000 THEN 0 ELSE 1 END AS fresh FROM ev)
SELECT eventId, userId || '-' || (sum(fresh) OVER (PARTITION BY userId ORDER BY ms, eventId ROWS UNBOUNDED PRECEDING))::BIGINT AS sessionId FROM marked""")
def p11_sessions(spark, sf_dir):
    return scrub.assign_sessions(all_events(spark, sf_dir).drop("sessionId")).select("eventId", "sessionId")


@query("p12_deduplicate", f"WITH {EV} SELECT DISTINCT eventId, eventType FROM ev")
def p12_deduplicate(spark, sf_dir):
    ev = all_events(spark, sf_dir)
    return scrub.deduplicate(ev.union(ev.filter(F.col("metadata.x") > 300))).select("eventId", "eventType")


# --- sessions, pages, journeys ---------------------------------------------------------------------------------------


def _sessions(name: str, gap: str) -> None:
    @query(name, f"WITH {EV}, {sessions_cte(gap)} SELECT {SESSION_COLUMNS} FROM ses")
    def run(spark, sf_dir):
        return flat(sessions.session_aggregates(good_events(spark, sf_dir), gap))


_sessions("a1_sessions_30m", "30 minutes")
_sessions("a1_sessions_12h", "12 hours")


def _pages(name: str, width: str) -> None:
    @query(name, f"WITH {EV}, {pages_cte(width)} SELECT {PAGE_COLUMNS} FROM pm")
    def run(spark, sf_dir):
        return flat(rounded(pages.page_metrics(good_events(spark, sf_dir), width), "avgScrollDepth"))


_pages("a2_pages_5m", "5 minutes")
_pages("a2_pages_1d", "1 day")


def _journey_sql(views: str, gap: str) -> str:
    return f"""WITH {EV}, views AS ({views}),
marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY userId, sessionId ORDER BY ts, eventId) <= INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM views),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY userId, sessionId ORDER BY ts, eventId ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT userId, sessionId, {text("min(ts)")} AS windowStart, {text(f"max(ts) + INTERVAL {gap}")} AS windowEnd, string_agg(pageUrl || '@' || {text("ts")} || ':' || clicks, '|' ORDER BY ts, pageUrl, clicks) AS orderedPages,
  epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS totalSessionDuration, userId || '_' || sessionId || '_' || {text("min(ts)")} AS _compositeKey FROM numbered GROUP BY userId, sessionId, s"""


def flat_journeys(df: DataFrame) -> DataFrame:
    step = lambda s: F.concat(s["pageUrl"], F.lit("@"), F.date_format(s["timestamp"], "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(":"), s["clicksOnPage"].cast("string"))
    return flat(df.withColumn("orderedPages", F.array_join(F.transform("orderedPages", step), "|")))


@query("a3_journeys_12h", _journey_sql("SELECT eventId, userId, sessionId, pageUrl, ts, 0 AS clicks FROM va WHERE eventType = 'PAGE_VIEW'", "12 hours"))
def a3_journeys_12h(spark, sf_dir):
    return flat_journeys(journeys.user_journeys(good_events(spark, sf_dir), "12 hours"))


_VIEWS = """SELECT v.eventId, v.userId, v.sessionId, v.pageUrl, v.ts, count(c.eventId) AS clicks FROM (SELECT * FROM va WHERE eventType = 'PAGE_VIEW') v LEFT JOIN (
  SELECT *, last_value(CASE WHEN eventType = 'PAGE_VIEW' THEN eventId END IGNORE NULLS) OVER (PARTITION BY userId, sessionId ORDER BY ts, eventId ROWS UNBOUNDED PRECEDING) AS viewId FROM va) c
  ON c.viewId = v.eventId AND c.eventType = 'CLICK' AND c.pageUrl = v.pageUrl GROUP BY ALL"""


@query("a5_journey_clicks_12h", _journey_sql(_VIEWS, "12 hours"))
def a5_journey_clicks_12h(spark, sf_dir):
    return flat_journeys(journeys.user_journeys(good_events(spark, sf_dir), "12 hours", clicks=True))


@query("j2_clicks_by_view", f"WITH {EV} SELECT eventId, userId, sessionId, pageUrl, {text('ts')} AS ts, clicks AS clicksOnPage FROM ({_VIEWS})")
def j2_clicks_by_view(spark, sf_dir):
    return flat(journeys.clicks_by_view(good_events(spark, sf_dir)))


@query("a19_journey_steps", f"""WITH {EV}, marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY userId, sessionId ORDER BY ts, eventId) <= INTERVAL 12 hours THEN 0 ELSE 1 END AS fresh FROM va WHERE eventType = 'PAGE_VIEW'),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY userId, sessionId ORDER BY ts, eventId ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT userId, sessionId, {text("min(ts) OVER (PARTITION BY userId, sessionId, s)")} AS windowStart, (row_number() OVER o)::INT AS sequence, pageUrl, {text("ts")} AS timestamp, 0 AS clicksOnPage,
  lead(ms) OVER o - ms AS stepDurationMs FROM numbered WINDOW o AS (PARTITION BY userId, sessionId, s ORDER BY ts, pageUrl)""")
def a19_journey_steps(spark, sf_dir):
    return flat(journeys.journey_steps(journeys.user_journeys(good_events(spark, sf_dir), "12 hours")))


@query("a4_bounce_rates", f"""WITH {EV}, {sessions_cte('12 hours')}, {pages_cte('1 DAY')},
rates AS (SELECT pageUrl, time_bucket(INTERVAL 1 DAY, windowStart) AS windowStart, avg(bounced::INT) AS bounceRate FROM (SELECT unnest(pages) AS pageUrl, windowStart, bounced FROM ses) GROUP BY ALL)
SELECT pm.pageUrl, {text("pm.windowStart")} AS windowStart, totalViews, uniqueVisitors, round(coalesce(bounceRate, 0), 6) AS bounceRate FROM pm LEFT JOIN rates USING (pageUrl, windowStart)""")
def a4_bounce_rates(spark, sf_dir):
    ev = good_events(spark, sf_dir)
    out = pages.page_metrics_with_bounces(ev, sessions.session_aggregates(ev, "12 hours"), "1 day")
    return flat(rounded(out, "bounceRate").select("pageUrl", "windowStart", "totalViews", "uniqueVisitors", "bounceRate"))


# --- live metrics ----------------------------------------------------------------------------------------------------


def _snapshot(as_of: str, users: int, clicks: int) -> str:
    return f"""WITH {EV}, t AS (SELECT {as_of} AS t) SELECT (count(DISTINCT userId) FILTER (t - ms < {users}))::INT AS activeUsers, round((count(*) FILTER (eventType = 'CLICK' AND t - ms < {clicks})) / {clicks / 1000}::DOUBLE, 6) AS clicksPerSecond,
  round((count(*) FILTER (t - ms < {clicks})) / {clicks / 1000}::DOUBLE, 6) AS eventRate, any_value(t) AS computedAt FROM va, t"""


@query("a10_snapshot_latest", _snapshot("(SELECT max(ms) FROM va)", 12 * 3_600_000, 3_600_000 * 6))
def a10_snapshot_latest(spark, sf_dir):
    """Active users of 12 hours, clicks and events a second of 6 hours at the time of the last event (this table has few events a minute)."""
    ev = good_events(spark, sf_dir)
    latest = ev.agg(F.max("timestamp")).first()[0] or 0
    return rounded(live.live_snapshot(ev, latest, 12 * 3_600_000, 6 * 3_600_000, 6 * 3_600_000), "clicksPerSecond", "eventRate")


@query("a10_snapshot_days", _snapshot(f"{AS_OF}::BIGINT", 5 * DAY_MS, DAY_MS))
def a10_snapshot_days(spark, sf_dir):
    """The same metrics with windows of days in the middle of the table, so that the windows select."""
    return rounded(live.live_snapshot(good_events(spark, sf_dir), AS_OF, 5 * DAY_MS, DAY_MS, DAY_MS), "clicksPerSecond", "eventRate")


@query("a9_trending", f"WITH {EV} SELECT pageUrl, count(*)::INT AS viewCount FROM va WHERE {AS_OF} - ms < {2 * DAY_MS} GROUP BY pageUrl ORDER BY viewCount DESC, pageUrl LIMIT 10")
def a9_trending(spark, sf_dir):
    return live.trending_pages(good_events(spark, sf_dir), AS_OF, 2 * DAY_MS)


def _series(name: str, width: str, slide: str, n: int) -> None:
    sql = f"""WITH {EV}, slid AS (SELECT *, time_bucket(INTERVAL {slide}, ts) - w * INTERVAL {slide} AS s FROM va, range(0, {n}) r(w))
SELECT {text("s")} AS windowStart, {text(f"s + INTERVAL {width}")} AS windowEnd, count(DISTINCT userId) AS activeUsers, count(*) FILTER (eventType = 'CLICK') AS clicks, count(*) AS events FROM slid GROUP BY s"""

    @query(name, sql)
    def run(spark, sf_dir):
        return flat(live.metric_series(good_events(spark, sf_dir), width, slide))


_series("a11_series_5m", "5 minutes", "1 minute", 5)
_series("a11_series_1m", "1 minute", "1 minute", 1)
_series("a11_series_15m", "15 minutes", "1 minute", 15)


@query("a22_changes", f"""WITH {EV}, s AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS w, count(DISTINCT userId) AS activeUsers, count(*) FILTER (eventType = 'CLICK') AS clicks, count(*) AS events FROM va GROUP BY 1)
SELECT {text("a.w")} AS windowStart, {text("a.w + INTERVAL 1 hour")} AS windowEnd, a.activeUsers, a.clicks, a.events, round(CASE WHEN b.activeUsers > 0 THEN (a.activeUsers - b.activeUsers) * 100.0 / b.activeUsers END, 6)::DOUBLE AS activeUsersChange,
  round(CASE WHEN b.clicks > 0 THEN (a.clicks - b.clicks) * 100.0 / b.clicks END, 6)::DOUBLE AS clicksChange, round(CASE WHEN b.events > 0 THEN (a.events - b.events) * 100.0 / b.events END, 6)::DOUBLE AS eventsChange FROM s a LEFT JOIN s b ON b.w + INTERVAL 1 hour = a.w""")
def a22_changes(spark, sf_dir):
    series = live.metric_series(good_events(spark, sf_dir), "1 hour", "1 hour")
    return flat(rounded(live.metric_changes(series), "activeUsersChange", "clicksChange", "eventsChange"))


@query("w3_recent_events", f"WITH {EV} SELECT eventId, userId, ms AS timestamp, count(*) OVER (PARTITION BY userId ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS recent FROM ev")
def w3_recent_events(spark, sf_dir):
    return live.users_before(all_events(spark, sf_dir), 3_600_000)


# --- counts, rankings, funnels -----------------------------------------------------------------------------------------


@query("a12_sessions_by_user", f"WITH {EV}, {sessions_cte('12 hours')} SELECT userId, count(*) AS n FROM ses GROUP BY userId")
def a12_sessions_by_user(spark, sf_dir):
    return curated.counts_by_user(sessions.session_aggregates(good_events(spark, sf_dir), "12 hours"))


@query("a13_events_by_type", f"WITH {EV} SELECT eventType, count(*) AS n FROM ev GROUP BY eventType")
def a13_events_by_type(spark, sf_dir):
    return curated.counts_by(all_events(spark, sf_dir), "eventType")


def _top(name: str, column: str, kind: str | None) -> None:
    where = f"AND eventType = '{kind}'" if kind else ""
    sql = f"""WITH {EV}, c AS (SELECT pageUrl, {column}, count(*) AS n FROM va WHERE {column} IS NOT NULL {where} GROUP BY ALL)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY pageUrl ORDER BY n DESC, {column}))::INT AS rank FROM c) WHERE rank <= 3"""

    @query(name, sql)
    def run(spark, sf_dir):
        return pages.top_by_page(good_events(spark, sf_dir), column, 3, kind)


_top("a14_top_referrers", "referrerUrl", None)
_top("a15_top_targets", "targetElement", "CLICK")
_EXPLODED = f"WITH {EV}, {sessions_cte('12 hours')}, sp AS (SELECT unnest(pages) AS pageUrl, exitPage, durationMs FROM ses)"


@query("a16_exit_rates", f"{_EXPLODED} SELECT pageUrl, count(*) AS sessions, count(*) FILTER (exitPage = pageUrl) AS exits, round((count(*) FILTER (exitPage = pageUrl))::DOUBLE / count(*), 6) AS exitRate FROM sp GROUP BY pageUrl")
def a16_exit_rates(spark, sf_dir):
    return rounded(pages.exit_rates(sessions.session_aggregates(good_events(spark, sf_dir), "12 hours")), "exitRate")


@query("a20_session_durations", f"{_EXPLODED} SELECT pageUrl, count(*) AS sessions, round(avg(durationMs), 6) AS avgSessionDurationMs FROM sp GROUP BY pageUrl")
def a20_session_durations(spark, sf_dir):
    return rounded(pages.session_durations(sessions.session_aggregates(good_events(spark, sf_dir), "12 hours")), "avgSessionDurationMs")


@query("a18_extended_sessions", f"WITH {EV}, {sessions_cte('12 hours')} SELECT {SESSION_COLUMNS}, eventCount, devices, browsers FROM ses")
def a18_extended_sessions(spark, sf_dir):
    return flat(sessions.session_aggregates(good_events(spark, sf_dir), "12 hours", extended=True))


@query("a21_heatmap", f"WITH {EV} SELECT pageUrl, (x // 100)::INT AS xBin, (y // 100)::INT AS yBin, count(*) AS clicks FROM va WHERE eventType = 'CLICK' GROUP BY ALL")
def a21_heatmap(spark, sf_dir):
    return pages.click_heatmap(good_events(spark, sf_dir))


@query("a17_funnel", f"""WITH {EV}, t0 AS (SELECT userId, min(ts) AS t FROM va WHERE eventType = 'PAGE_VIEW' GROUP BY userId),
t1 AS (SELECT userId, min(va.ts) AS t FROM va JOIN t0 USING (userId) WHERE eventType = 'CLICK' AND va.ts > t0.t GROUP BY userId),
t2 AS (SELECT userId, min(va.ts) AS t FROM va JOIN t1 USING (userId) WHERE eventType = 'SCROLL' AND va.ts > t1.t GROUP BY userId),
n AS (SELECT (SELECT count(*) FROM t0) AS a, (SELECT count(*) FROM t1) AS b, (SELECT count(*) FROM t2) AS c)
SELECT 1 AS step, 'view' AS name, a AS sessions, 1.0::DOUBLE AS conversionRate FROM n UNION ALL SELECT 2, 'click', b, round(b::DOUBLE / a, 6) FROM n UNION ALL SELECT 3, 'scroll', c, round(c::DOUBLE / a, 6) FROM n""")
def a17_funnel(spark, sf_dir):
    steps: list[tuple[str, Column]] = [("view", sessions.is_type("PAGE_VIEW")), ("click", sessions.is_type("CLICK")), ("scroll", sessions.is_type("SCROLL"))]
    return rounded(funnel.funnel(good_events(spark, sf_dir), steps, keys=("userId",)), "conversionRate")


# --- curated tables ------------------------------------------------------------------------------------------------

START, END = "2024-01-05 00:00:00", "2024-01-12 00:00:00"
_SES = f"WITH {EV}, {sessions_cte('12 hours')} SELECT {SESSION_COLUMNS} FROM ses"
_RANGE = f"windowStart BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
_SES_WHERE = lambda where: f"WITH {EV}, {sessions_cte('12 hours')}, chosen AS (SELECT * FROM ses WHERE {where}) SELECT {SESSION_COLUMNS} FROM chosen"
_PM_WHERE = lambda where: f"WITH {EV}, {pages_cte('1 DAY')}, chosen AS (SELECT * FROM pm WHERE {where}) SELECT {PAGE_COLUMNS} FROM chosen"


#: Where this session has written a curated table of a data folder, by the operator's name.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def curated_table(spark: SparkSession, sf_dir: str, name: str, key: str, make: Query) -> DataFrame:
    """A curated table, written for lookups when it is first asked for and read from then on, as services read what the jobs wrote."""
    place = (spark.sparkContext.applicationId, sf_dir, name)
    if place not in _WRITTEN or not exists(spark, _WRITTEN[place]):  # the scratch folder may have been cleared
        path = scratch_path(spark, name)
        maintenance.write_for_lookup(make(spark, sf_dir), path, key)
        _WRITTEN[place] = path
    return spark.read.parquet(_WRITTEN[place])


def curated_sessions(spark, sf_dir):
    return curated_table(spark, sf_dir, "sessions", "userId", lambda *a: sessions.session_aggregates(good_events(*a), "12 hours"))


def curated_pages(spark, sf_dir):
    return curated_table(spark, sf_dir, "page-metrics", "pageUrl", lambda *a: pages.page_metrics(good_events(*a), "1 day"))


def curated_journeys(spark, sf_dir):
    return curated_table(spark, sf_dir, "user-journeys", "userId", lambda *a: journeys.user_journeys(good_events(*a), "12 hours"))


def _curated(name: str, sql: str, base: Query, pick: Callable[[DataFrame], DataFrame]) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        df = pick(base(spark, sf_dir)).drop("date")
        return flat(rounded(df, "avgScrollDepth") if "avgScrollDepth" in df.columns else df)


_curated("q1_sessions_page", f"SELECT * FROM ({_SES}) ORDER BY windowStart DESC, _compositeKey LIMIT 20 OFFSET 40", curated_sessions, lambda d: curated.page_of(d, 2))
_curated("q2_sessions_user", _SES_WHERE("userId = 'user-7'"), curated_sessions, lambda d: curated.sessions(d, "user-7"))
_curated("q3_sessions_range", _SES_WHERE(_RANGE), curated_sessions, lambda d: curated.sessions(d, start=START, end=END))
_curated("q4_sessions_user_range", _SES_WHERE(f"userId = 'user-7' AND {_RANGE}"), curated_sessions, lambda d: curated.sessions(d, "user-7", START, END))
_curated("q5_sessions_one_bound", _SES_WHERE("userId = 'user-7'"), curated_sessions, lambda d: curated.sessions(d, "user-7", START, None))
_curated("q6_session_by_id", _SES_WHERE("sessionId = 'sess-7-20240105'"), curated_sessions, lambda d: curated.session_by_id(d, "sess-7-20240105"))
_curated("q7_session_count", f"WITH {EV}, {sessions_cte('12 hours')} SELECT count(*) AS n FROM ses WHERE userId = 'user-7'", curated_sessions, lambda d: curated.session_counts(d, "user-7"))
_curated("q8_long_sessions", _SES_WHERE("durationMs >= 21600000"), curated_sessions, lambda d: curated.long_sessions(d, 21_600_000))
_curated("q9_pages_page", f"SELECT * FROM (WITH {EV}, {pages_cte('1 DAY')} SELECT {PAGE_COLUMNS} FROM pm) ORDER BY windowStart DESC, _compositeKey LIMIT 20", curated_pages, lambda d: curated.page_of(d))
_curated("q10_pages_url", _PM_WHERE("pageUrl = 'https://shop.example/p/3'"), curated_pages, lambda d: curated.page_metrics(d, "https://shop.example/p/3"))
_curated("q11_pages_range", _PM_WHERE(_RANGE), curated_pages, lambda d: curated.page_metrics(d, start=START, end=END))
_curated("q12_pages_url_range", _PM_WHERE(f"pageUrl = 'https://shop.example/p/3' AND {_RANGE}"), curated_pages, lambda d: curated.page_metrics(d, "https://shop.example/p/3", START, END))
_curated("q13_top_windows", f"SELECT * FROM ({_PM_WHERE(_RANGE)}) ORDER BY totalViews DESC, _compositeKey LIMIT 10", curated_pages, lambda d: curated.top_pages(d, START, END))
_curated("q13_top_pages", f"WITH {EV}, {pages_cte('1 DAY')} SELECT pageUrl, sum(totalViews)::BIGINT AS totalViews FROM pm WHERE {_RANGE} GROUP BY pageUrl ORDER BY totalViews DESC, pageUrl LIMIT 5", curated_pages, lambda d: curated.top_pages(d, START, END, 5, per_page=True))
_curated("q16_envelope", f"WITH {EV}, {sessions_cte('12 hours')} SELECT 2 AS page, 20 AS size, count(*) AS totalElements, ceil(count(*) / 20.0)::BIGINT AS totalPages, 3 < ceil(count(*) / 20.0) AS hasNext, TRUE AS hasPrevious FROM ses", curated_sessions, lambda d: curated.envelope(d, 2))
_curated(
    "f13_display", f"WITH {EV}, {sessions_cte('12 hours')} SELECT sessionId || '_' || {text('windowStart')} AS _compositeKey, (durationMs // 60000) || 'm ' || (durationMs // 1000 % 60) || 's' AS durationText FROM ses", curated_sessions, lambda d: curated.display(d).select("_compositeKey", "durationText")
)
_A3 = _journey_sql("SELECT eventId, userId, sessionId, pageUrl, ts, 0 AS clicks FROM va WHERE eventType = 'PAGE_VIEW'", "12 hours")


@query("q14_journeys_user", f"SELECT * FROM ({_A3}) WHERE userId = 'user-7'")
def q14_journeys_user(spark, sf_dir):
    return flat_journeys(curated.journeys_of_user(curated_journeys(spark, sf_dir), "user-7").drop("date"))


@query("q15_journey_session", f"SELECT * FROM ({_A3}) WHERE sessionId = (SELECT min('sess-' || user_id || '-' || strftime(ts, '%Y%m%d')) FROM events WHERE event_type = 'view')")
def q15_journey_session(spark, sf_dir):
    """The journey of the first session by name."""
    table = curated_journeys(spark, sf_dir)
    return flat_journeys(curated.journey_of_session(table, table.agg(F.min("sessionId")).first()[0] or "").drop("date"))


@query("f13_percent", f"{_EXPLODED} SELECT pageUrl, printf('%.1f%%', 100.0 * (count(*) FILTER (exitPage = pageUrl)) / count(*)) AS exitPercent FROM sp GROUP BY pageUrl")
def f13_percent(spark, sf_dir):
    """Exit rates as percentages."""
    return pages.exit_rates(sessions.session_aggregates(good_events(spark, sf_dir), "12 hours")).select("pageUrl", curated.percent("exitRate").alias("exitPercent"))


# --- maintenance and audits ------------------------------------------------------------------------------------------


@query("m1_expire", f"WITH {EV}, {pages_cte('1 DAY')}, chosen AS (SELECT * FROM pm WHERE windowStart >= TIMESTAMP '2024-02-14' - INTERVAL 30 DAYS) SELECT {PAGE_COLUMNS} FROM chosen")
def m1_expire(spark, sf_dir):
    return flat(rounded(maintenance.expire(curated_pages(spark, sf_dir).drop("date"), "2024-02-14 00:00:00"), "avgScrollDepth"))


@query("m3_compact", f"WITH {EV} {_HOURS}, count(*) AS n FROM ev GROUP BY ALL")
def m3_compact(spark, sf_dir):
    """The lake, written in two batches, compacted; counted by folder."""
    path, target, ev = scratch_path(spark, "lake"), scratch_path(spark, "compacted"), all_events(spark, sf_dir)
    for part in (ev.filter(F.col("timestamp") < AS_OF), ev.filter(F.col("timestamp") >= AS_OF)):
        sinks.archive(part, path)
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0").alias(c)
    return maintenance.compact(spark, path, target).select(pad("year", 4), pad("month", 2), pad("day", 2), pad("hour", 2)).groupBy("year", "month", "day", "hour").agg(F.count("*").alias("n"))


@query("m5_rate_violations", f"WITH {EV} SELECT userId, {text('time_bucket(INTERVAL 1 hour, ts)')} AS windowStart, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1")
def m5_rate_violations(spark, sf_dir):
    """More than one event of a user in an hour (this table has no denser bursts)."""
    return flat(maintenance.rate_violations(all_events(spark, sf_dir), 1, "1 hour"))


@query("m6_key_skew", f"""WITH {EV}, c AS (SELECT (('0x' || substr(md5(userId), 1, 8))::BIGINT % 6)::INT AS partition, count(*) AS n FROM ev GROUP BY 1)
SELECT partition, n, round(n * 6.0 / (SELECT sum(n) FROM c), 6)::DOUBLE AS skew FROM c""")
def m6_key_skew(spark, sf_dir):
    return rounded(maintenance.key_skew(all_events(spark, sf_dir), "userId"), "skew")


@query("io10_reingest", f"WITH {_V} SELECT eventId FROM checked WHERE eventType <> 'ERROR' AND list_filter(errors, lambda m: m NOT LIKE 'timestamp%') = [] AND len(errors) > 0 AND ms >= {V_AS_OF} AND ms <= {V_AS_OF + DAY_MS + 300000}")
def io10_reingest(spark, sf_dir):
    """Events rejected for a time in the future are taken in a day later, if the archive lacks them."""
    good, bad = validation.split_valid(all_events(spark, sf_dir), V_AS_OF)
    return maintenance.reingest(bad.withColumn("batch_id", F.lit(0)), good, V_AS_OF + DAY_MS).select("eventId")


@query("m2_retention", f"WITH {EV} SELECT eventId FROM ev WHERE ts >= TIMESTAMP '2024-01-20 07:00:00'")
def m2_retention(spark, sf_dir):
    """The lake without the hour folders before a cutoff."""
    path = scratch_path(spark, "lake")
    sinks.archive(all_events(spark, sf_dir), path)
    maintenance.drop_before(spark, path, dt.datetime(2024, 1, 20, 7))
    return spark.read.parquet(path).select("eventId")


@query("m4_lookup_layout", _SES_WHERE("userId = 'user-7'"))
def m4_lookup_layout(spark, sf_dir):
    """Sessions written for lookups by user, and one user's read back."""
    path = scratch_path(spark, "lookup")
    maintenance.write_for_lookup(sessions.session_aggregates(good_events(spark, sf_dir), "12 hours"), path, "userId")
    return flat(spark.read.parquet(path).drop("date").filter(F.col("userId") == "user-7"))


@query("io9_quarantine", f"WITH {_V} SELECT eventId, array_to_string(errors, '|') AS errors, 7 AS batch_id FROM checked WHERE len(errors) > 0")
def io9_quarantine(spark, sf_dir):
    """A batch routed as a stream routes it: what is rejected, read back from quarantine."""
    path = scratch_path(spark, "errors")
    sinks.route(lambda good, batch_id: None, path, V_AS_OF)(all_events(spark, sf_dir).drop("ts"), 7)
    return flat(spark.read.schema("eventId string, errors array<string>, batch_id int").option("recursiveFileLookup", "true").json(path))


# --- streams ---------------------------------------------------------------------------------------------------------


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, for a stream takes no single file
    return sources.table_events(files).filter(F.col("eventType") != "ERROR")


@query("s_stream_pages", f"WITH {EV}, {pages_cte('1 DAY')} SELECT pageUrl, {text('windowStart')} AS windowStart, totalViews, clickCount, round(avgScrollDepth, 6) AS avgScrollDepth FROM pm")
def s_stream_pages(spark, sf_dir):
    """Page metrics as a stream in update mode, merged by key; equal to the batch."""
    root = scratch_path(spark, "stream")
    q = jobs._start(pages.page_metrics(sources.with_watermark(stream_events(spark, sf_dir)), "1 day", exact=False), "page-metrics", root, "update", None)
    q.awaitTermination()
    out = sinks.KeyedTable(spark, f"{root}/tables/page-metrics").read()
    return flat(rounded(out, "avgScrollDepth").select("pageUrl", "windowStart", "totalViews", "clickCount", "avgScrollDepth"))


@query("s_stream_sessions", f"WITH {EV}, {sessions_cte('12 hours')}, closed AS (SELECT * FROM ses WHERE windowEnd <= (SELECT max(ts) FROM va) - INTERVAL 10 minutes) SELECT {SESSION_COLUMNS} FROM closed")
def s_stream_sessions(spark, sf_dir):
    """Sessions as a stream in append mode: those that the watermark has passed."""
    root = scratch_path(spark, "stream")
    q = jobs._start(sessions.session_aggregates(sources.with_watermark(stream_events(spark, sf_dir)), "12 hours"), "sessions", root, "append", None)
    q.awaitTermination()
    return flat(sinks.KeyedTable(spark, f"{root}/tables/sessions").read().drop("updatedAt"))


@query("s_stream_archive", f"WITH {EV} SELECT eventId, strftime(ts, '%Y-%m-%d-%H') AS folder FROM va")
def s_stream_archive(spark, sf_dir):
    """The raw archive as a stream; each event with the folder that it is read back from."""
    root = scratch_path(spark, "stream")
    jobs.start_archive(stream_events(spark, sf_dir), root, None).awaitTermination()
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return spark.read.parquet(f"{root}/lake").select("eventId", F.concat_ws("-", pad("year", 4), pad("month", 2), pad("day", 2), pad("hour", 2)).alias("folder"))


@query(
    "s_stream_journeys",
    f"""{_A3.replace("SELECT userId, sessionId, strftime(min(ts)", "SELECT max(ts) + INTERVAL 12 hours AS closes, userId, sessionId, strftime(min(ts)", 1)}""".replace("WITH ", "WITH closed AS (WITH ", 1)
    + f") SELECT * EXCLUDE (closes) FROM closed WHERE closes <= (SELECT max(ts) FROM events WHERE event_type = 'view') - INTERVAL 10 minutes",
)
def s_stream_journeys(spark, sf_dir):
    """Journeys as a stream in append mode: those that the watermark of page views has passed."""
    root = scratch_path(spark, "stream")
    views = stream_events(spark, sf_dir).filter(sessions.is_type("PAGE_VIEW"))
    jobs._start(journeys.user_journeys(sources.with_watermark(views), "12 hours"), "user-journeys", root, "append", None).awaitTermination()
    return flat_journeys(sinks.KeyedTable(spark, f"{root}/tables/user-journeys").read().drop("updatedAt"))


@query(
    "s_stream_clicks",
    f"""WITH {EV}, vc AS (SELECT * FROM va WHERE eventType IN ('PAGE_VIEW', 'CLICK')), views AS ({_VIEWS.replace("FROM va", "FROM vc")}),
ranked AS (SELECT *, lead(eventId) OVER (PARTITION BY userId, sessionId ORDER BY ts, eventId) AS following FROM views),
lasts AS (SELECT userId, sessionId, max(ms) AS last FROM vc GROUP BY ALL)
SELECT eventId, sessionId, pageUrl, clicks AS clicksOnPage FROM ranked JOIN lasts USING (userId, sessionId) WHERE following IS NOT NULL OR last + 1800000 < (SELECT max(ms) FROM vc) - 600000""",
)
def s_stream_clicks(spark, sf_dir):
    """Clicks per page view by state for each session: views that the next one or the session's silence has closed, as last reported."""
    root = scratch_path(spark, "stream")
    out = jobs.clicks_by_view_stream(stream_events(spark, sf_dir), early=True).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    out.trigger(availableNow=True).start().awaitTermination()
    return jobs.last_reports(spark.read.parquet(f"{root}/out")).select("eventId", "sessionId", "pageUrl", "clicksOnPage")


def piped(spark: SparkSession, sf_dir: str) -> str:
    """All events as JSON values in files, with text that is no event beside every hundredth, through the whole pipeline (without scrubbing) as of V_AS_OF; the
    folder of its outputs."""
    place = (spark.sparkContext.applicationId, sf_dir, "pipeline")
    if place not in _WRITTEN:
        root = scratch_path(spark, "pipeline")
        values = all_events(spark, sf_dir).select("eventId", sinks.event_json().alias("value"))
        broken = F.when(F.col("eventId").endswith("00"), F.substring("value", 1, 20))
        values.select(F.explode(F.array_compact(F.array("value", broken))).alias("value")).write.text(f"{root}/in")
        started = jobs.start_pipeline(spark.readStream.schema("value string").text(f"{root}/in"), root, "12 hours", "1 day", every=None, as_of_ms=V_AS_OF, pane="1 hour", scrubbing=False)
        for q in started.values():
            q.awaitTermination()
        _WRITTEN[place] = root
    return _WRITTEN[place]


_OK = f"{_V}, ok AS (SELECT * FROM checked WHERE len(errors) = 0)"


@query("s_pipeline_pages", f"WITH {_OK} SELECT pageUrl, {text('time_bucket(INTERVAL 1 DAY, ts)')} AS windowStart, count(*) FILTER (eventType = 'PAGE_VIEW') AS totalViews, count(*) FILTER (eventType = 'CLICK') AS clickCount FROM ok GROUP BY ALL")
def s_pipeline_pages(spark, sf_dir):
    """Page metrics of the valid events that the whole job took in."""
    return flat(sinks.KeyedTable(spark, f"{piped(spark, sf_dir)}/tables/page-metrics").read().select("pageUrl", "windowStart", "totalViews", "clickCount"))


@query("s_pipeline_archive", f"WITH {_OK} SELECT eventId FROM ok")
def s_pipeline_archive(spark, sf_dir):
    return spark.read.parquet(f"{piped(spark, sf_dir)}/lake").select("eventId")


@query(
    "s_pipeline_scrubbed",
    f"""WITH {_V} SELECT eventId, sha256('s1' || userId) AS userId, least(1.0, greatest(0.0, scrollDepth)) AS depth FROM checked
WHERE list_filter(errors, lambda m: m <> 'scrollDepth must lie in 0 to 1') = []""",
)
def s_pipeline_scrubbed(spark, sf_dir):
    """What a pipeline that scrubs first archives: depths are clamped before they are judged, users are hashed."""
    root = scratch_path(spark, "scrubbed")
    sinks.keyed_json(all_events(spark, sf_dir)).select("value").write.text(f"{root}/in")
    checked = jobs.checked_values(spark.readStream.schema("value string").text(f"{root}/in"), V_AS_OF, salt="s1")
    jobs.start_archive(checked.filter(F.size("errors") == 0).drop("errors"), root, None).awaitTermination()
    return spark.read.parquet(f"{root}/lake").select("eventId", "userId", F.col("metadata.scrollDepth").alias("depth"))


_NO_EVENT = "eventId is required|userId is required|sessionId is required|eventType is required|pageUrl is required|timestamp is required"


@query("s_pipeline_quarantine", f"WITH {_V} SELECT eventId, array_to_string(errors, '|') AS errors FROM checked WHERE len(errors) > 0 UNION ALL SELECT NULL, '{_NO_EVENT}' FROM ev WHERE event_id % 100 = 0 AND event_id > 0")
def s_pipeline_quarantine(spark, sf_dir):
    """What the whole job rejected, with the reasons."""
    return flat(spark.read.schema("eventId string, errors array<string>").option("recursiveFileLookup", "true").json(f"{piped(spark, sf_dir)}/quarantine"))


@query("s_live_series", f"""WITH {EV}, slid AS (SELECT *, time_bucket(INTERVAL 30 minutes, ts) - w * INTERVAL 30 minutes AS s FROM va, range(0, 2) r(w))
SELECT {text("s")} AS windowStart, {text("s + INTERVAL 1 hour")} AS windowEnd, count(*) FILTER (eventType = 'CLICK') AS clicks, count(*) AS events FROM slid GROUP BY s""")
def s_live_series(spark, sf_dir):
    """The live series from panes that a stream keeps in update mode (users, which are approximate there, are left out)."""
    root = scratch_path(spark, "stream")
    jobs.start_live(stream_events(spark, sf_dir), root, "30 minutes", every=None).awaitTermination()
    return flat(live.series_of(sinks.KeyedTable(spark, f"{root}/tables/live-panes").read(), "1 hour", "30 minutes").select("windowStart", "windowEnd", "clicks", "events"))


def live_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Panes of an hour of the trailing days, kept by a stream, and the last hour that its watermark has passed."""
    place, span = (spark.sparkContext.applicationId, sf_dir, "live-panes"), dt.timedelta(days=5)
    if place not in _WRITTEN:
        root = scratch_path(spark, "stream")
        q = jobs.start_live(stream_events(spark, sf_dir), root, "1 hour", every=None)
        q.awaitTermination()
        _WRITTEN[place] = f"{root} {jobs.last_watermark(q).replace(minute=0, second=0, microsecond=0):%Y-%m-%dT%H:%M:%S}"
    root, _, at = _WRITTEN[place].rpartition(" ")
    as_of = dt.datetime.fromisoformat(at)
    return sinks.KeyedTable(spark, f"{root}/tables/live-panes").between(as_of - span, as_of), F.lit(at).cast("timestamp")


_MARK = f"WITH {EV}, mark AS (SELECT date_trunc('hour', max(ts) - INTERVAL 10 minutes) AS t FROM va)"


@query("s_live_trending", f"{_MARK} SELECT pageUrl, count(*)::INT AS viewCount FROM va, mark WHERE ts < t AND ts >= t - INTERVAL 2 days GROUP BY pageUrl ORDER BY viewCount DESC, pageUrl LIMIT 10")
def s_live_trending(spark, sf_dir):
    """The pages with most events of two days before the watermark, from the panes that a stream keeps."""
    return live.trending_of(*live_table(spark, sf_dir), 2 * DAY_MS)


@query(
    "s_live_snapshot",
    f"""{_MARK} SELECT round((count(*) FILTER (eventType = 'CLICK' AND ts >= t - INTERVAL 6 hours)) / 21600.0::DOUBLE, 6) AS clicksPerSecond, round((count(*) FILTER (ts >= t - INTERVAL 6 hours)) / 21600.0::DOUBLE, 6) AS eventRate,
  epoch_ms(any_value(t)) AS computedAt FROM va, mark WHERE ts < t AND ts >= t - INTERVAL 5 days""",
)
def s_live_snapshot(spark, sf_dir):
    """Clicks and events a second of six hours before the watermark, from the same panes (users, approximate there, are left out)."""
    return rounded(live.snapshot_of(*live_table(spark, sf_dir), 5 * DAY_MS, DAY_MS // 4, DAY_MS // 4).drop("activeUsers"), "clicksPerSecond", "eventRate")


@query(
    "s_stream_bounces",
    f"""WITH {EV}, {sessions_cte('12 hours')}, visits AS (SELECT unnest(pages) AS pageUrl, time_bucket(INTERVAL 1 DAY, windowEnd - INTERVAL 1 microsecond) AS w, bounced FROM ses)
SELECT pageUrl, {text("w")} AS windowStart, {text("w + INTERVAL 1 DAY")} AS windowEnd, count(*) AS sessions, round(avg(bounced::INT), 6) AS bounceRate FROM visits
WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM va) - INTERVAL 10 minutes GROUP BY pageUrl, w""",
)
def s_stream_bounces(spark, sf_dir):
    """Bounce rates by the day in which sessions end, by two chained steps with state: days that the watermark has passed."""
    root = scratch_path(spark, "stream")
    jobs._start(pages.closing_bounces(sources.with_watermark(stream_events(spark, sf_dir)), "12 hours", "1 day"), "page-bounces", root, "append", None).awaitTermination()
    return flat(rounded(sinks.KeyedTable(spark, f"{root}/tables/page-bounces").read().select("pageUrl", "windowStart", "windowEnd", "sessions", "bounceRate"), "bounceRate"))


def _settled(spark: SparkSession, out: DataFrame, select: list[str]) -> DataFrame:
    """Runs a stream over what is there and reads what it wrote."""
    root = scratch_path(spark, "stream")
    out.select(*select).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


_PASSED = "(SELECT max(ms) FROM va) - 600000"


@query("s_stream_debounce", f"""WITH {EV}, {{bursts}} SELECT eventId FROM bursts WHERE eventType <> 'CLICK' OR ((after IS NULL OR after - ms >= 21600000) AND ms + 21600000 <= {_PASSED})""".replace(
    "{bursts}", "bursts AS (SELECT *, lead(ms) OVER (PARTITION BY userId, eventType ORDER BY ms, eventId) AS after FROM va)"))
def s_stream_debounce(spark, sf_dir):
    """Click bursts (of 6 hours, as in p10_debounce) as a stream: bursts that the watermark has passed, and all other events."""
    return _settled(spark, stateful.debounce_stream(stream_events(spark, sf_dir), keys=("userId",), gap_ms=21_600_000), ["eventId"])


@query("s_stream_session_ids", f"""WITH {EV}, marked AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY userId ORDER BY ms, eventId) < 1800000 THEN 0 ELSE 1 END AS fresh FROM va),
numbered AS (SELECT eventId, ms, userId || '-' || (sum(fresh) OVER (PARTITION BY userId ORDER BY ms, eventId ROWS UNBOUNDED PRECEDING))::BIGINT AS sessionId FROM marked)
SELECT eventId, sessionId FROM numbered WHERE ms < {_PASSED}""")
def s_stream_session_ids(spark, sf_dir):
    """Session ids as a stream by keyed state: events that the watermark has passed."""
    return _settled(spark, stateful.assign_sessions_stream(stream_events(spark, sf_dir)), ["eventId", "sessionId"])


# --- lookups over what streams keep ------------------------------------------------------------------------------------


def _laid_out(name: str, key: str) -> Query:
    """A table that a streaming job keeps, laid out for lookups when it is first asked for; jobs whose tables nobody asks for don't run."""

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        place = (spark.sparkContext.applicationId, sf_dir, f"streamed {name}")
        if place not in _WRITTEN:
            root = scratch_path(spark, "stream")
            for q in jobs.start_jobs(stream_events(spark, sf_dir), root, "12 hours", "1 day", every=None, names=[name]).values():
                q.awaitTermination()
            _WRITTEN[place] = root
        root = _WRITTEN[place]
        sinks.lay_out(sinks.KeyedTable(spark, f"{root}/tables/{name}"), f"{root}/lookup/{name}", key)
        return spark.read.parquet(f"{root}/lookup/{name}").drop("updatedAt")

    return read


_LOOKUPS = {"sessions": _laid_out("sessions", "userId"), "pages": _laid_out("page-metrics", "pageUrl"), "journeys": _laid_out("user-journeys", "userId")}
_CLOSED = "windowEnd <= (SELECT max(ts) FROM va) - INTERVAL 10 minutes"
_STREAMED_PAGES = lambda sql: f"SELECT * EXCLUDE (uniqueVisitors) FROM ({sql})"  # noqa: E731  (approximate in streams)


def _streamed(name: str, sql: str, table: str, pick: Callable[[DataFrame], DataFrame]) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        df = pick(_LOOKUPS[table](spark, sf_dir)).drop("date", "uniqueVisitors")
        return flat(rounded(df, "avgScrollDepth") if "avgScrollDepth" in df.columns else df)


_streamed("sq1_sessions_page", f"SELECT * FROM ({_SES_WHERE(_CLOSED)}) ORDER BY windowStart DESC, _compositeKey LIMIT 20 OFFSET 40", "sessions", lambda d: curated.page_of(d, 2))
_streamed("sq2_sessions_user", _SES_WHERE(f"userId = 'user-7' AND {_CLOSED}"), "sessions", lambda d: curated.sessions(d, "user-7"))
_streamed("sq3_sessions_range", _SES_WHERE(f"{_RANGE} AND {_CLOSED}"), "sessions", lambda d: curated.sessions(d, start=START, end=END))
_streamed("sq4_sessions_user_range", _SES_WHERE(f"userId = 'user-7' AND {_RANGE} AND {_CLOSED}"), "sessions", lambda d: curated.sessions(d, "user-7", START, END))
_streamed("sq6_session_by_id", _SES_WHERE(f"sessionId = 'sess-7-20240105' AND {_CLOSED}"), "sessions", lambda d: curated.session_by_id(d, "sess-7-20240105"))
_streamed("sq8_long_sessions", _SES_WHERE(f"durationMs >= 21600000 AND {_CLOSED}"), "sessions", lambda d: curated.long_sessions(d, 21_600_000))
_streamed("sq12_pages_url_range", _STREAMED_PAGES(_PM_WHERE(f"pageUrl = 'https://shop.example/p/3' AND {_RANGE}")), "pages", lambda d: curated.page_metrics(d, "https://shop.example/p/3", START, END))
_streamed("sq13_top_windows", _STREAMED_PAGES(f"SELECT * FROM ({_PM_WHERE(_RANGE)}) ORDER BY totalViews DESC, _compositeKey LIMIT 10"), "pages", lambda d: curated.top_pages(d, START, END))


@query("sq14_journeys_user", f"SELECT * FROM ({_A3}) WHERE userId = 'user-7' AND windowEnd <= (SELECT strftime(max(ts) - INTERVAL 10 minutes, '%Y-%m-%d %H:%M:%S.%g') FROM events WHERE event_type <> 'error')")
def sq14_journeys_user(spark, sf_dir):
    return flat_journeys(curated.journeys_of_user(_LOOKUPS["journeys"](spark, sf_dir), "user-7").drop("date"))


@query("q1_sessions_after", f"SELECT * FROM ({_SES}) ORDER BY windowStart DESC, _compositeKey LIMIT 20 OFFSET 40")
def q1_sessions_after(spark, sf_dir):
    """The third page, found after the last row of the second."""
    table = curated_sessions(spark, sf_dir)
    last = curated.page_of(table, 1).select("windowStart", "_compositeKey").collect()[-1:]
    return flat(curated.page_after(table, tuple(last[0]) if last else None).drop("date"))

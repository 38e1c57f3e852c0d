import pytest
from events import T0, frame, row
from pyspark.sql import functions as F

from clickweave.functions import validation
from clickweave.sources import events as sources
from clickweave.streaming import jobs, sinks

BASE = {"eventId": "valid-event-123", "userId": "user-456", "sessionId": "sess-789", "eventType": "PAGE_VIEW", "pageUrl": "https://example.com/page", "timestamp": T0}
META = {"x": None, "y": None, "scrollDepth": None, "viewportWidth": None, "viewportHeight": None, "elementText": None, "durationMs": None, "version": None, "deviceType": None, "screenResolution": None}


def meta(**values):
    return tuple((META | values).values())


CASES = [
    ({}, []),
    ({"eventId": None}, ["eventId is required"]),
    ({"eventId": "  "}, ["eventId is required"]),
    ({"userId": None}, ["userId is required"]),
    ({"sessionId": ""}, ["sessionId is required"]),
    ({"eventType": None}, ["eventType is required"]),
    ({"eventType": "SWIPE"}, ["eventType is unknown"]),
    ({"pageUrl": None}, ["pageUrl is required"]),
    ({"timestamp": None}, ["timestamp is required"]),
    ({"timestamp": 0}, ["timestamp must be positive"]),
    ({"timestamp": -1000}, ["timestamp must be positive"]),
    ({"timestamp": T0 + 300_001}, ["timestamp is in the future"]),
    ({"timestamp": T0 + 300_000}, []),
    ({"timestamp": T0 - 86_400_001}, ["timestamp is too old"]),
    ({"timestamp": T0 - 86_400_000}, []),
    ({"timestamp": 17452800000000}, ["timestamp is in the future"]),
    ({"eventType": "CLICK", "targetElement": None}, ["CLICK needs targetElement"]),
    ({"eventType": "CLICK", "targetElement": "b", "metadata": meta(x=1)}, ["CLICK needs x and y"]),
    ({"eventType": "CLICK", "targetElement": "b", "metadata": meta(x=1, y=2)}, []),
    ({"eventType": "CLICK", "targetElement": "b"}, []),
    ({"eventType": "SCROLL"}, ["SCROLL needs scrollDepth"]),
    ({"eventType": "SCROLL", "metadata": meta(scrollDepth=-0.1)}, ["scrollDepth must lie in 0 to 1"]),
    ({"eventType": "SCROLL", "metadata": meta(scrollDepth=1.1)}, ["scrollDepth must lie in 0 to 1"]),
    ({"eventType": "SCROLL", "metadata": meta(scrollDepth=0.0)}, []),
    ({"eventType": "SCROLL", "metadata": meta(scrollDepth=1.0)}, []),
    ({"eventType": "HOVER", "targetElement": None, "metadata": meta(durationMs=5)}, ["HOVER needs targetElement"]),
    ({"eventType": "HOVER", "targetElement": "b"}, ["HOVER needs durationMs"]),
    ({"eventType": "HOVER", "targetElement": "b", "metadata": meta(durationMs=5)}, []),
    ({"sessionId": "user-456"}, ["sessionId equals userId"]),
    *(({"metadata": meta(elementText=t)}, ["elementText names personal data"]) for t in ("Enter Password", "SSN: 123-45-6789", "Credit-Card Number", "PIN code")),
    ({"metadata": meta(elementText="spinning")}, []),
    ({"userAgent": "Mozilla/5.0 (192.168.0.1)"}, ["userAgent holds an IP address"]),
    ({"userAgent": "Mozilla/5.0 Chrome/120.0.0.0"}, []),
    *(({"targetElement": t}, ["targetElement holds markup or script"]) for t in ("<script>x", "JavaScript:alert(1)", "<iframe src=x>", "img onerror=x")),
    ({"pageUrl": "ftp://example.com/x"}, ["pageUrl must use http or https"]),
    ({"pageUrl": "www.example.com/x"}, ["pageUrl has no scheme"]),
    ({"pageUrl": "http://exa mple.com"}, ["pageUrl is not a valid URL"]),
    ({"referrerUrl": "ftp://example.com/x"}, ["referrerUrl must use http or https"]),
    ({"referrerUrl": ""}, []),
    ({"eventId": "x" * 256}, ["eventId is longer than 255"]),
    ({"eventId": "x" * 255}, []),
    ({"userId": "x" * 256}, ["userId is longer than 255"]),
    ({"sessionId": "x" * 256}, ["sessionId is longer than 255"]),
    ({"referrerUrl": "https://e.com/" + "x" * 2048}, ["referrerUrl is longer than 2048"]),
    ({"targetElement": "x" * 513}, ["targetElement is longer than 512"]),
    ({"userAgent": "x" * 8193}, ["userAgent is longer than 8192"]),
    ({"metadata": meta(elementText="x" * 1025)}, ["elementText is longer than 1024"]),
    ({"pageUrl": "https://e.com/?q=javascript:x"}, ["pageUrl holds markup or script"]),
    ({"metadata": meta(elementText="a <iframe src=x>")}, ["elementText holds markup or script"]),
    ({"pageUrl": "https://e.com/" + "x" * 2048}, ["pageUrl is longer than 2048"]),
    ({"eventId": None, "timestamp": 0, "eventType": "SCROLL"}, ["eventId is required", "timestamp must be positive", "SCROLL needs scrollDepth"]),
]


def test_rules(spark):
    base = row(*(BASE[c] for c in ("eventId", "userId", "sessionId", "eventType", "pageUrl")))
    rows = [base | change | {"schemaVersion": str(k)} for k, (change, _) in enumerate(CASES)]
    got = {int(r.schemaVersion): r.errors for r in validation.validate(frame(spark, rows), T0).collect()}
    assert {k: got[k] for k in got} == {k: expected for k, (_, expected) in enumerate(CASES)}


def test_split_and_reasons(spark):
    df = frame(spark, [row("a", "u", "s", "PAGE_VIEW", "https://e.com/"), row("b", "u", "s", "X", "https://e.com/"), row("c", "u", "s", "X", "")])
    good, bad = validation.split_valid(df, T0)
    assert [r.eventId for r in good.collect()] == ["a"]
    assert {r.reason: r.n for r in validation.reason_counts(bad).collect()} == {"eventType is unknown": 2, "pageUrl is required": 1}
    assert round(validation.acceptance_rate(validation.validate(df, T0)).first().rate, 3) == 0.333


@pytest.mark.parametrize(("n", "bad", "accepted", "first"), [(3, [], True, None), (101, [], False, None), (3, [1], False, 1)])
def test_batches(spark, n, bad, accepted, first):
    rows = [row(f"e{k}", "u", "s", "X" if k in bad else "PAGE_VIEW", "https://e.com/") for k in range(n)]
    arrays = sinks.keyed_json(frame(spark, rows)).selectExpr("concat('[', array_join(array_sort(collect_list(value)), ','), ']') AS value")
    batches = validation.judge_batches(validation.validate(sources.parse_json_batches(arrays), T0)).collect()
    assert [(b.n, b.accepted) for b in batches] == [(n, accepted)]
    assert (batches[0].first_invalid is None) == (first is None)


def test_json_parsing(spark):
    lines = ['{"eventId": "a", "referrer": "https://r.com", "timestamp": 1704067200123}', "no json", '{"eventId": "b", "referrerUrl": "https://q.com", "timestamp": "x"}']
    got = sources.with_event_time(sources.parse_json(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()
    assert [(r.eventId, r.referrerUrl, r.timestamp) for r in got] == [("a", "https://r.com", 1704067200123), (None, None, None), ("b", "https://q.com", None)]
    assert str(got[0].ts) == "2024-01-01 00:00:00.123000"


def test_json_is_parsed_once_a_row_whatever_is_filtered(spark):
    """Spark moves a filter on errors below a projection, with a parse for each column that it names (40 here before)."""
    values = spark.createDataFrame([('{"eventId": "a", "referrer": "https://r.com"}',), (None,), ("[",)], "value string")
    for rows in (jobs.checked_values(values, T0, scrubbing) for scrubbing in (False, True)):
        bad = rows.filter(F.size("errors") > 0)
        plan = bad._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == plan.count("CLICK needs x and y") == 1
        assert sorted((r.eventId or "", r.referrerUrl or "", len(r.errors)) for r in bad.collect()) == [("", "", 6), ("", "", 6), ("a", "https://r.com", 5)]

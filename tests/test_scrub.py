import pytest
from events import frame, row
from pyspark.sql import functions as F

from clickweave.functions import scrub


def apply(spark, function, *values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.o for r in df.withColumn("o", function(F.col("v"))).orderBy("k").collect()]


def test_addresses(spark):
    got = apply(spark, scrub.anonymize_ip, "192.168.1.77", "1.2.3", "", None, "2001:db8:85a3:0:0:8a2e:370:7334", "a:b", "::1")
    assert got == ["192.168.1.0", "0.0.0.0", "0.0.0.0", "0.0.0.0", "2001:db8:85a3::", "::", "::1::"]


def test_ids(spark):
    assert apply(spark, scrub.mask_id, "abcd", "abcde", None, "") == ["***", "abcd***", "***", "***"]
    assert len(apply(spark, lambda c: scrub.hash_id(c, "s"), "u")[0]) == 64


def test_markup_and_urls(spark):
    assert apply(spark, scrub.strip_markup, "<b>x</b>y", "a" * 300) == ["xy", "a" * 200]
    assert apply(spark, scrub.sanitize_url, "https://e.com/<script>alert(1)</script>?onclick=1&u=javascript:x", "ftp://<a>'\"") == ["https://e.com/?1&u=x", "ftp://a"]
    assert apply(spark, scrub.http_only, "http://e.com", "android-app://x", None) == ["http://e.com", None, None]


def test_sensitive_and_depth(spark):
    assert apply(spark, scrub.is_sensitive, "input#CreditCard", "my-PASSWORD", "button", None) == [True, True, False, False]
    df = spark.createDataFrame([(-0.5,), (0.5,), (1.5,), (None,)], "d double").select(scrub.clamp_depth(F.col("d")).alias("d"))
    assert [r.d for r in df.collect()] == [0.0, 0.5, 1.0, None]


def test_debounce(spark):
    rows = [row(f"e{k}", "u", "s", "CLICK", "/", at, targetElement="b") for k, at in enumerate((0, 150, 349, 549))] + [row("v", "u", "s", "PAGE_VIEW", "/", 10)]
    assert sorted(r.eventId for r in scrub.debounce(frame(spark, rows)).collect()) == ["e2", "e3", "v"]


@pytest.mark.parametrize(("gap", "n"), [(30 * 60_000 - 1, 1), (30 * 60_000, 2)])
def test_assigned_sessions(spark, gap, n):
    df = scrub.assign_sessions(frame(spark, [row("a", "u", None, "CLICK", "/", 0), row("b", "u", None, "CLICK", "/", gap)]))
    assert df.select("sessionId").distinct().count() == n


def test_deduplicate(spark):
    assert scrub.deduplicate(frame(spark, [row("a", "u", "s", "CLICK", "/")] * 3 + [row("b", "u", "s", "CLICK", "/")])).count() == 2

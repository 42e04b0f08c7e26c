from pyspark.sql import functions as F

from findings_engine.functions import net, risk, text, url


def values(spark, column, *cells):
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    return [r[0] for r in df.select(column(F.col("c"))).collect()]


def test_slug(spark):
    assert values(spark, text.slug, " Senior  Engineer (m/f) ", "", "--", None) == ["senior-engineer-m-f", "", "", None]


def test_sentinels_and_enums(spark):
    assert values(spark, text.is_sentinel, "—", " n/A ", "-", "", None, "x") == [True, True, True, True, True, False]
    assert values(spark, lambda c: text.resolved(c, risk.LEVELS), " high ", "Extreme") == ["High", None]


def test_url_identity_fast_equals_slow(spark):
    cells = ["http://A.example.com/x/?utm_source=f&b=2&a=1#top", "https://a.b/", "https://a.b", "http://a.b/p//", "https://a.b/#/jobs/x-1", "http://a.b/?ref=x&q", "http://a.b/x?b=1&a=2&b=0"]
    want = ["http://a.example.com/x?a=1&b=2", "https://a.b/", "https://a.b/", "http://a.b/p", "https://a.b/#/job/x-1", "http://a.b/?q=", "http://a.b/x?a=2&b=1&b=0"]
    assert values(spark, url.normalized, *cells) == want
    assert [url.normalized_text(c) for c in cells] == want


def test_url_identity_slow(spark):
    assert values(spark, url.normalized, "HTTP://Ex.com:80/a b/../c?x=~ é", "ftp://X", None, "http://") == ["http://ex.com/c?x=%7E+%C3%A9", "ftp://x", None, "http://"]


def test_risk_levels(spark):
    cells = ["C1", "H1,H2", "H1 M1;M2", "H1", "m1,m2", "M1", "", "H4", "L2", "H5 M1"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").withColumn("k", risk.codes(F.col("c")))
    level = risk.level(F.col("k"))
    rows = df.select(level, F.array_join(risk.categories(F.col("k")), ","), risk.confidence(F.col("k"), level), risk.tier(level)).collect()
    assert [r[0] for r in rows] == ["Critical", "High", "High", "Medium", "Medium", "Low", "Low", "Medium", "Low", "Medium"]
    assert [r[1] for r in rows][6:] == ["Likely Genuine", "Scam", "Likely Genuine", "Ghost/Stale,Suspicious"]
    assert (rows[6][2], rows[5][2], rows[8][2], rows[0][3]) == ("Medium", "Medium", "Low", "Suspicious")


def test_blocked_addresses(spark):
    got = values(spark, lambda c: net.blocked(net.to_int(c)), "10.0.0.1", "172.31.9.9", "172.32.0.1", "8.8.8.8", "255.1.1.1")
    assert got == [True, True, False, False, True]


def test_padding(spark):
    assert values(spark, lambda c: text.padded(c.cast("long")), "7", "1234") == ["007", "1234"]

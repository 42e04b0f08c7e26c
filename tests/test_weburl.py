"""Golden cases of URLs, written out by hand from the URL standard."""

import pytest
from pyspark.sql import functions as F

from findings_engine.functions import url, weburl

GOLDEN = [
    # text, identity, host
    ("https://Example.COM/Path", "https://example.com/Path", "example.com"),
    ("http://[::1]/x", "http://[::1]/x", "[::1]"),
    ("http://[2001:DB8:0:0:1:0:0:1]:8080/", "http://[2001:db8::1:0:0:1]:8080/", "[2001:db8::1:0:0:1]"),
    ("http://[::ffff:1.2.3.4]/", "http://[::ffff:102:304]/", "[::ffff:102:304]"),
    ("http://[1:0:0:4:0:0:0:8]/", "http://[1:0:0:4::8]/", "[1:0:0:4::8]"),
    ("http://[1:2]/", "http://[1:2]/", ""),
    ("http://[::1%25eth0]/", "http://[::1%25eth0]/", ""),
    ("https://a.b/p?x=a\\b", "https://a.b/p?x=a%5Cb", "a.b"),
    ("https://a.b\\c\\d", "https://a.b/c/d", "a.b"),
    ("https://EX%41.com/", "https://exa.com/", "exa.com"),
    ("https://ex%2Fa.com/", "https://ex%2fa.com/", ""),
    ("https://bücher.example/ä", "https://xn--bcher-kva.example/%C3%A4", "xn--bcher-kva.example"),
    ("https://BÜCHER。example/", "https://xn--bcher-kva.example/", "xn--bcher-kva.example"),
    ("https://faß.de/", "https://xn--fa-hia.de/", "xn--fa-hia.de"),
    ("https://a\tb.com/x\ny", "https://ab.com/xy", "ab.com"),
    ("http://0x7f.1/", "http://127.0.0.1/", "127.0.0.1"),
    ("http://017700000001/", "http://127.0.0.1/", "127.0.0.1"),
    ("http://1.2.3.4.5/", "http://1.2.3.4.5/", ""),
    ("http://256.1.1.1/", "http://256.1.1.1/", ""),
    ("http://a.b.:81/x", "http://a.b.:81/x", "a.b."),
    ("https://a.b:443/x", "https://a.b/x", "a.b"),
    ("http://a.b:443/x", "http://a.b:443/x", "a.b"),
    ("http://a.b:99999/x", "http://a.b:99999/x", ""),
    ("http://a.b:8a/x", "http://a.b:8a/x", ""),
    ("https://u:p@a.b/x", "https://u:p@a.b/x", "a.b"),
    ("https://u@v:w@a.b/", "https://u%40v:w@a.b/", "a.b"),
    ("https://a.b/x/../y/./z/%2e%2E/w", "https://a.b/y/w", "a.b"),
    ("https://a.b/x/..", "https://a.b/", "a.b"),
    ('https://a.b/"<>`{}|', "https://a.b/%22%3C%3E%60%7B%7D|", "a.b"),
    ("https://a.b/%zz%41", "https://a.b/%zz%41", "a.b"),
    ("https://a.b/?b=2&a=%20+x&utm_source=n&a=1&c", "https://a.b/?a=++x&a=1&b=2&c=", "a.b"),
    ("https://a.b/?%C3=1", "https://a.b/?%EF%BF%BD=1", "a.b"),
    ("https://a.b/x#/job/A-1/y", "https://a.b/x/#/job/A-1", "a.b"),
    ("https:///a.b/x", "https://a.b/x", "a.b"),
    ("https://", "https://", ""),
    ("https://a b/", "https://a b/", ""),
    ("https://a|b/", "https://a|b/", ""),
    ("https://?x", "https://?x", ""),
    ("See Notes/more", "see notes/more", "see notes"),
    ("", "", ""),
    ("  https://a.b/x/  ", "https://a.b/x", "a.b"),
]


@pytest.mark.parametrize("text,identity,host", GOLDEN)
def test_golden(text, identity, host):
    assert (url.normalized_text(text), url.host_text(text)) == (identity, host)


def test_columns_agree(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in GOLDEN] + [(None,)], "u string")
    got = [tuple(r) for r in df.select("u", url.normalized(F.trim("u")), url.host(F.col("u"))).collect()]
    assert got == [*((t, i, h) for t, i, h in GOLDEN), (None, None, None)]
    same = [tuple(r) for r in url.with_normalized(df, "u", "n").select("u", "n").collect()]
    assert sorted(same, key=str) == sorted(((t, i) for t, i, _ in [*GOLDEN, (None, None, None)]), key=str)


def test_identity_is_stable():
    """The identity of an identity is itself, where it is a URL."""
    for _, identity, host in GOLDEN:
        if host and identity.startswith("http") and "#" not in identity:
            assert url.normalized_text(identity) == identity and weburl.parsed(identity).host == host

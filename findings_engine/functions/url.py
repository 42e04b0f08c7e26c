"""URL identity as Column expressions, for absolute URLs of plain ASCII; a vectorised function takes the others."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import weburl
from .text import WHITE_SPACE, slug, trimmed

# Beginnings of keys, and keys, of parameters that only track.
TRACKING_PREFIXES = ("utm_", "fbclid", "gclid", "msclkid", "igshid", "mc_cid", "mc_eid")
TRACKING_KEYS = ("referrer", "ref")
_PLAIN = r"^https?://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:/[A-Za-z0-9_.\-/]*)?(?:\?[A-Za-z0-9_=&.\-]*)?(?:#[A-Za-z0-9_\-/]*)?\z"
_DOTS = r"/\.{1,2}(?:/|\?|#|\z)"
_NUMERIC_HOST = r"^https?://(?:[^/?#]*\.)?(?:[0-9]+|0[xX][0-9a-fA-F]*)(?:[/?#]|\z)"


def is_tracking(key: Column) -> Column:
    low = F.lower(key)
    out = low.isin(*TRACKING_KEYS)
    for p in TRACKING_PREFIXES:
        out |= F.startswith(low, F.lit(p))
    return out


def _is_plain(url: Column) -> Column:
    return F.rlike(url, F.lit(_PLAIN)) & ~F.rlike(url, F.lit(_DOTS)) & ~F.rlike(url, F.lit(_NUMERIC_HOST))


def normalized(url: Column) -> Column:
    """The identity of a URL: lower-case host, tracking parameters and fragment dropped, the others sorted by key."""
    plain = _is_plain(url)
    return F.when(plain, _fast(url)).otherwise(_slow(F.when(~plain, url)))  # the vectorised function gets nulls for plain ones


def with_normalized(df: DataFrame, column: str, name: str, host_name: str | None = None) -> DataFrame:
    """The rows with the identity of a URL, and its host if that is named. Plain URLs stay in SQL; only the others are sent to the vectorised functions."""
    url = trimmed(F.col(column))
    plain = F.coalesce(_is_plain(url), F.lit(True))
    one, other = df.filter(plain).withColumn(name, _fast(url)), df.filter(~plain).withColumn(name, _slow(url))
    if host_name:
        one, other = one.withColumn(host_name, F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1))), other.withColumn(host_name, _slow_host(F.col(column)))
    return one.unionByName(other)


def _fast(url: Column) -> Column:
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    origin = F.lower(F.regexp_extract(base, "^(https?://[^/]*)", 1))
    path = F.regexp_replace(base, "^https?://[^/]*", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    pair = F.transform(pairs, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("k"), i.alias("i"), F.when(F.contains(x, F.lit("=")), x).otherwise(F.concat(x, F.lit("="))).alias("x")))
    rest = F.array_sort(F.filter(pair, lambda p: ~is_tracking(p["k"])))
    query = F.array_join(F.transform(rest, lambda p: p["x"]), "&")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+\\z", "")).otherwise(path)
    path = F.when(path == "", "/").otherwise(path)
    href = F.concat(origin, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    job = F.regexp_extract(url, "#(/jobs?/([A-Za-z0-9-]+))", 2)
    return F.when(job != "", F.concat(F.regexp_replace(href, "/\\z", ""), F.lit("/#/job/"), job)).otherwise(href)


def normalized_text(raw: str | None) -> str | None:
    """The same for any text, row by row; what is no http(s) URL is lower-cased."""
    if raw is None:
        return None
    text = re.sub(f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "", raw)
    u = weburl.parsed(text) if re.match("(?i)https?://", text) else None
    if u is None:
        return text.lower()
    keep = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if not (k.lower() in TRACKING_KEYS or k.lower().startswith(TRACKING_PREFIXES))]
    keep.sort(key=lambda kv: kv[0].encode("utf-16-be", "replace"))
    form = lambda x: quote_plus(x, safe="*-._").replace("~", "%7E")
    path = u.path.rstrip("/") or "/" if len(u.path) > 1 else u.path
    href = u.written(path, "&".join(f"{form(k)}={form(v)}" for k, v in keep))
    job = re.match("/jobs?/([A-Za-z0-9-]+)", u.fragment)
    return f"{href.removesuffix('/')}/#/job/{job[1]}" if job else href


def host_text(raw: str | None) -> str | None:
    """The host that ``normalized_text`` has, brackets of IPv6 included; of other texts what stands before the first slash."""
    if raw is None:
        return None
    text = re.sub(f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "", raw)
    u = weburl.parsed(text) if re.match("(?i)https?:", text) else None
    return u.host if u else "" if re.match("(?i)https?:", text) else text.split("/", 1)[0].lower()


@F.pandas_udf(StringType())
def _slow(url: pd.Series) -> pd.Series:
    return url.map(normalized_text, na_action="ignore")


def identity(url: Column, title: Column, source: Column) -> Column:
    """``url:`` and the URL's identity, or without a URL ``title:…|src:…``."""
    by_title = F.concat(F.lit("title:"), slug(F.coalesce(title, F.lit(""))), F.lit("|src:"), slug(F.coalesce(source, F.lit(""))))
    return F.when(F.rlike(url, F.lit("(?i)^https?://")), F.concat(F.lit("url:"), normalized(trimmed(url)))).otherwise(by_title)


@F.pandas_udf(StringType())
def _slow_host(url: pd.Series) -> pd.Series:
    return url.map(host_text, na_action="ignore")


def host(url: Column) -> Column:
    """The host as the identity has it; empty for what begins like an http(s) URL and is none, and else what stands before the first slash."""
    plain = _is_plain(trimmed(url))
    authority = F.regexp_extract(trimmed(url), r"^https?://([^/?#]*)", 1)
    return F.when(plain, F.lower(authority)).otherwise(_slow_host(F.when(~plain, url)))


def has_suffix(h: Column, suffix: str) -> Column:
    return (h == suffix) | F.endswith(h, F.lit(f".{suffix}"))

"""The queries of this subpackage.

None of the first ten has an oracle in SQL: each is tested against a brute-force version. What SQL can say of four of them, it says of
a query that selects those columns from the operator's own query. The queries of operators 11 and 13 are said in SQL whole,
of operator 12's the sizes and targets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids_sql, collocations_sql
from .centroids import op13_centroids
from .collocations import op11_collocations
from .mixing import MOST, PERCENT, WEIGHTS, op12_mixing
from .mpeg_audio import op9_mpeg_audio
from .packing import op2_packing
from .quality import op7_quality
from .secrets_scan import op6_secrets
from .sentencepiece_codec import op1_sentencepiece
from .simhash import op8_simhash
from .sketches import op5_sketches
from .token_counts import op3_token_counts
from .toxicity import op10_toxicity
from .url_rules import op4_url_rules

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_AFTER = "CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_PATH = "regexp_extract(regexp_replace(a, '^[^/?#]*', ''), '^[^?#]*')"
_UNDER = lambda name: f"(host = '{name}' OR ends_with(host, '.{name}'))"


def url_rules_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_url_rules(spark, sf_dir).select("page_id", "host", "path", "rule")


def sketches_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_sketches(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mpeg_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_mpeg_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


ORACLES = {
    "op11_collocations": collocations_sql.SQL,
    # the sources whose cap is low for their weight are capped one after the other; the rest share what is left by weight
    "mixing_targets": rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {list(WEIGHTS)}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w FROM d GROUP BY source),
k AS (SELECT *, {PERCENT} * sum(source_size) OVER () - coalesce(sum({100 * MOST} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM s WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, source)),
f AS (SELECT left_, open_ FROM k WHERE left_ * w <= {100 * MOST} * source_size * open_ ORDER BY CAST(source_size AS DOUBLE) / w, source LIMIT 1)
SELECT doc_id, size, source_size, CASE WHEN f.left_ IS NULL OR f.left_ * w > {100 * MOST} * source_size * f.open_ THEN CAST({MOST} * source_size AS DOUBLE) ELSE CAST(f.left_ * w AS DOUBLE) / CAST(100 * f.open_ AS DOUBLE) END AS target
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source LEFT JOIN f ON true""",
    "op13_centroids": centroids_sql.SQL,
    "url_rules_parts": f"""WITH p AS (SELECT page_id, {_AFTER} AS a FROM pages), h AS (SELECT page_id, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {_PATH} AS path FROM p)
SELECT page_id, host, path, CASE WHEN {_UNDER('example.org')} AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN {_UNDER('example.org')} AND starts_with(path, '/es/') THEN 'example.org/es/' WHEN {_UNDER('com')} AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN {_UNDER('com')} AND starts_with(path, '/de/') THEN 'com/de/' WHEN {_UNDER('org')} AND starts_with(path, '/') THEN 'org/' END AS rule FROM h""",
    "sketches_edits": """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM t)
SELECT doc_id, length(text) AS n_chars, sha256(substr(text, 1, length(text) - length(text) // 2) || substr(following, 1, length(text) // 2)) AS edited_sha256 FROM n""",
    "secrets_base": f"SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 2), lambda x: length(x) >= 8)) AS n_assign, len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM documents",
    "mpeg_payloads": """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT *, octet_length(b) AS n, greatest((octet_length(b) + 63) // 64 * 64, 64) AS m FROM b)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(b || repeat('\\x00'::BLOB, m - n)) AS payload_sha256 FROM n""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sentencepiece, op2_packing, op3_token_counts, op4_url_rules, op5_sketches, op6_secrets, op7_quality, op8_simhash, op9_mpeg_audio, op10_toxicity, op11_collocations, op12_mixing, op13_centroids)
    return {f.__name__: f for f in (*own, url_rules_parts, sketches_edits, secrets_base, mpeg_payloads, mixing_targets)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

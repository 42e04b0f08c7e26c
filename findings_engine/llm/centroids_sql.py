"""Operator 13's query in SQL: every round over all pairs of a vector and a centroid."""

from .centroids import BITS, CENTROIDS, DIMENSIONS, ROUNDS


def _assign(n: int) -> str:
    return f"""a{n} AS MATERIALIZED (SELECT vec_id, place, q, min(struct_pack(d := d, c := c)) AS m FROM (SELECT v.vec_id, v.place, v.q, k.c, list_sum(list_transform(list_zip(v.q, k.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{n} k) GROUP BY vec_id, place, q)"""


def _move(n: int) -> str:
    """floor(s / n) in whole numbers, whatever the sign of s."""
    return f"""c{n + 1} AS MATERIALIZED (SELECT k.c, coalesce(any_value(moved.q), any_value(k.q)) AS q FROM c{n} k LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM (SELECT m.c AS c, i, sum(q[i]) AS s, count(*) AS n FROM a{n}, range(1, {DIMENSIONS + 1}) r(i) GROUP BY ALL) GROUP BY c) moved USING (c) GROUP BY k.c)"""


SQL = f"""WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: CAST(floor({2**BITS} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY mark) - 1 AS c, q FROM (SELECT sha256('2:' || vec_id) AS mark, q FROM v ORDER BY mark LIMIT {CENTROIDS})),
{', '.join(f'{_assign(n)}, {_move(n)}' for n in range(ROUNDS))}, {_assign(ROUNDS)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.q, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} k ON k.c = m.c"""

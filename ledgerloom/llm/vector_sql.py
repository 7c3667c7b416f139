"""SQL of the vector operators' queries."""

from __future__ import annotations

KEPT = """embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
#: Exact: sums of products of a few dozen small whole numbers.
PRODUCT = "CAST(list_inner_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[])) AS BIGINT)"


def clustering_sql(k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:") -> str:
    """Lloyd's rounds, one after the other."""
    square = lambda v: PRODUCT.format(v, v)
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {WHOLE} AS v FROM embeddings WHERE {KEPT} AND len(embedding) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        distance = f"{square('kept.v')} - 2 * {PRODUCT.format('kept.v', f'c{n}.v')} + {square(f'c{n}.v')}"
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, vec_id, kept.v, c, {distance} AS d FROM kept, c{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT c, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({dims})) AS k FROM a{n}) GROUP BY c, k)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(f.v, o.v) AS v FROM c{n} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS v FROM m{n} GROUP BY c) f ON f.c = o.c)")
    last, names = f"a{rounds}", f"c{rounds}"
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(n.v, ',')) AS centroid_sha256
FROM {last} a JOIN {names} n ON n.c = a.c"""


NEGATIVES_SQL = f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {WHOLE} AS v FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND {KEPT}),
  s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, {PRODUCT.format("a.v", "b.v")} AS score FROM v a JOIN v b ON a.vec_id % 100 = 0),
  p AS (SELECT r, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) AS place FROM s WHERE same AND other_id <> anchor_id QUALIFY place <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.r, place ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score QUALIFY rank <= 10"""

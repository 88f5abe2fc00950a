"""SQL of the vector operators: the same rounds in long form, a row for each component."""

from __future__ import annotations

from cuesheet.llm import centroids, vector_codes

# Floored quotient of sums of either sign.
_MEAN = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
_FINITE = "embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0"


def _rounds(rounds: int, last: str) -> str:
    """Assignments ``a<i> (r, part, entry, d)`` of ``c (r, part, place, x)`` to entries
    ``b<i> (part, entry, place, y)``, and the moves between them."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
    SELECT r, part, entry, d FROM (
        SELECT *, row_number() OVER (PARTITION BY r, part ORDER BY d, entry) AS k FROM (
            SELECT r, part, entry, sum((x - y) * (x - y))::BIGINT AS d
            FROM c JOIN b{i} USING (part, place) GROUP BY r, part, entry)) WHERE k = 1)""")
        if i < rounds:
            steps.append(f"""
b{i + 1} AS MATERIALIZED (
    SELECT part, entry, place, coalesce(mean, y) AS y FROM b{i} LEFT JOIN (
        SELECT part, entry, place, {_MEAN} AS mean FROM c JOIN a{i} USING (r, part) GROUP BY part, entry, place)
    USING (part, entry, place))""")
    return ",".join(steps) + last


CODES = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding
    FROM embeddings WHERE {_FINITE}),
c AS MATERIALIZED (
    SELECT r, (i - 1) // (n // {vector_codes.PARTS}) AS part, (i - 1) % (n // {vector_codes.PARTS}) AS place,
           floor(4096 * x::DOUBLE)::BIGINT AS x
    FROM (SELECT r, len(embedding) AS n, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, place, x AS y FROM c WHERE r <= {vector_codes.ENTRIES}),
""" + _rounds(
    vector_codes.ROUNDS,
    f""",
coded AS MATERIALIZED (
    SELECT r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
    FROM a{vector_codes.ROUNDS} GROUP BY r),
books AS (
    SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b{vector_codes.ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r) CROSS JOIN books
""",
)

CENTROIDS = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, embedding) AS r, vec_id, embedding
    FROM embeddings WHERE {_FINITE} AND len(embedding) = {centroids.SIZE}),
c AS MATERIALIZED (
    SELECT r, 0 AS part, i AS place, floor(64 * x::DOUBLE)::BIGINT AS x
    FROM (SELECT r, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, place, x AS y FROM c WHERE r <= {centroids.CLUSTERS}),
""" + _rounds(
    centroids.ROUNDS,
    f""",
names AS (
    SELECT entry, sha256(string_agg(y::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM b{centroids.ROUNDS} GROUP BY entry)
SELECT vec_id, entry::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY entry))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN a{centroids.ROUNDS} USING (r) JOIN names USING (entry)
""",
)

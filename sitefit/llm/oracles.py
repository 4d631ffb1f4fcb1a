"""Check SQL (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

#: Finite vectors only; `r` tells repeated rows apart.
_FINE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

EXACT_TOPK = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_FINE}),
pairs AS (SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def _vector_codes() -> str:
    """Four rounds as a chain of common tables: books b0 to b4, assignments a0 to a4."""
    steps = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_FINE}),
size AS (SELECT CAST(max(len(e)) AS BIGINT) // 4 AS d FROM v),
p AS MATERIALIZED (SELECT r, k AS part, e[k * d + 1 : k * d + d] AS e, list_inner_product(e[k * d + 1 : k * d + d], e[k * d + 1 : k * d + d]) AS own FROM v, size, (SELECT unnest(range(4)) AS k)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS i FROM v),
b0 AS MATERIALIZED (SELECT part, i, e, own FROM p JOIN first USING (r) WHERE i < 256)"""]
    for k in range(5):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT r, part, min(far) AS far, arg_min(i, (far, i)) AS i FROM (
    SELECT p.r, p.part, b.i, p.own + b.own - 2 * list_inner_product(p.e, b.e) AS far FROM p JOIN b{k} b ON p.part = b.part) GROUP BY r, part)""")
        if k < 4:
            steps.append(f"""
m{k} AS (SELECT part, i, pos, sum(CAST(x AS BIGINT)) AS s, count(*) AS n FROM (
    SELECT p.part, a.i, unnest(p.e) AS x, unnest(range(len(p.e))) AS pos FROM p JOIN a{k} a ON p.r = a.r AND p.part = a.part) GROUP BY part, i, pos),
n{k} AS (SELECT part, i, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS e FROM m{k} GROUP BY part, i),
b{k + 1} AS MATERIALIZED (SELECT part, i, e, list_inner_product(e, e) AS own FROM (SELECT b.part, b.i, coalesce(n.e, b.e) AS e FROM b{k} b LEFT JOIN n{k} n ON b.part = n.part AND b.i = n.i))""")
    steps.append("""
book AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, i, pos)) AS s FROM (SELECT part, i, unnest(e) AS x, unnest(range(len(e))) AS pos FROM b4)),
c AS (SELECT r, string_agg(lower(printf('%02x', i)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM v JOIN c USING (r), book""")
    return "WITH" + ",".join(steps[:-1]) + "," + steps[-1]


COLLOCATIONS = r"""
WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS size))),
known AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
inside AS (SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[i : i + m - 1], ' ') AS phrase FROM (
        SELECT lang, f, phrase, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT lang, f, phrase, size, unnest(range(2, size)) AS m FROM known WHERE size > 2))) GROUP BY ALL),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(string_split(c.phrase, ' ')[1 : k], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[k + 1 :], ' ') AS tail
    FROM (SELECT *, unnest(range(1, size)) AS k FROM known WHERE size > 1) c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase WHERE i.longer IS NULL OR i.longer < c.f),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
    FROM cuts c JOIN known h ON c.lang = h.lang AND c.head = h.phrase JOIN known t ON c.lang = t.lang AND c.tail = t.phrase JOIN totals o ON c.lang = o.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS first FROM scored),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank FROM best WHERE first = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""

ORACLES = {"op11_exact_topk": EXACT_TOPK, "op12_vector_codes": _vector_codes(), "op13_collocations": COLLOCATIONS}

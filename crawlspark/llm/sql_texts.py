"""DuckDB SQL of the operators on repeated passages, phrases and vector codes."""

from __future__ import annotations

REPEATS = """
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), k AS (
  SELECT doc_id, x, unnest(range(0, length(x) // 2, 512)) AS pos FROM h
), p AS (
  SELECT doc_id, pos, substr(x, 2 * pos + 1, 2 * (512 + 99)) AS y, least(512, length(x) // 2 - pos) AS n FROM k
), b AS (
  SELECT doc_id, pos + unnest(range(n)) AS i, unnest(list_transform(range(n), lambda i: substr(y, 2 * i + 1, 200))) AS w FROM p
), s AS (
  SELECT doc_id, i, left(w, 2) AS byte, length(w) = 200 AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM b
), c AS (
  SELECT doc_id, i, byte, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM s
), e AS (
  SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS begins FROM c
), r AS (
  SELECT doc_id, count(*) AS n_bytes, count_if(gone) AS n_removed, count_if(begins) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id
)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN r USING (doc_id)
"""

_PHRASES = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, s AS words, unnest(list_transform(generate_series(1, len(w) - s + 1), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS phrase
  FROM pieces, generate_series(1, 5) t(s) WHERE len(w) >= s
), f AS MATERIALIZED (
  SELECT lang, words, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= LEAST_N
), candidates AS (
  SELECT * FROM f WHERE words >= 2
), dropped AS (
  SELECT lang, unnest([regexp_extract(phrase, '^(.*) [^ ]*$', 1, 's'), regexp_extract(phrase, '^[^ ]* (.*)$', 1, 's')]) AS phrase, n
  FROM candidates WHERE words > 2
), cuts AS (
  SELECT c.lang, c.phrase, c.n AS a, k, array_to_string(string_split(c.phrase, ' ')[:k], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') AS tail
  FROM candidates c, generate_series(1, 4) t(k)
  WHERE k < c.words AND NOT EXISTS (FROM dropped d WHERE d.lang = c.lang AND d.phrase = c.phrase AND d.n = c.n)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.n AS l, y.n AS r, total.n AS n, ((1000::HUGEINT * a * total.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail JOIN total ON total.lang = cuts.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= TOP_N
"""


def phrases(least: int = 100, top: int = 2000) -> str:
    """All n-grams counted by text, then scored and dropped one by one."""
    return _PHRASES.replace("LEAST_N", str(least)).replace("TOP_N", str(top))


def vector_codes(rounds: int = 4) -> str:
    """Rounds of exact assignment and floored means, one pair of steps after the other."""
    floor = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE))"
    steps = [
        f"kept AS (SELECT vec_id, label, {floor} AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) r(p))",
        "c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x QUALIFY e < 256)",
    ]
    distance = "list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c)"
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min(({distance})::BIGINT * 256 + e) AS m FROM x JOIN c{k} USING (p) GROUP BY vec_id, p)")
        if k < rounds:
            means = f"SELECT p, m % 256 AS e, i, floor(sum(x[i]) / count(*)) AS y FROM a{k}, range(1, 65) r(i) WHERE i <= len(x) GROUP BY ALL"
            lists = f"SELECT p, e, list(y ORDER BY i) AS y FROM ({means}) GROUP BY p, e"
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(y, c) AS c FROM c{k} LEFT JOIN ({lists}) USING (p, e))")
    return f"""WITH {", ".join(steps)},
per AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda y: y::BIGINT), 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM per JOIN kept USING (vec_id), book"""

"""DuckDB SQL for text queries that SQL can express."""

from __future__ import annotations

import string

from . import quality

_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

PHRASES = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT doc_id, i, x, string_agg(x, ' ') OVER s AS k, count(*) OVER s AS n FROM x
  WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT doc_id, i, n = 13 AND min(doc_id) OVER (PARTITION BY k, n = 13) < doc_id AS hit FROM k),
c AS (SELECT doc_id, i, coalesce(bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS 12 PRECEDING), false) AS gone FROM f),
r AS (SELECT x.doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(x, ' ' ORDER BY x.i) FILTER (WHERE NOT gone) AS kept
  FROM x JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id"""

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
x AS (SELECT doc_id, len(w) AS m, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT doc_id, m, i, string_agg(x, ' ') OVER s AS k, count(*) OVER s AS n FROM x
  WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, k FROM k WHERE n = 3 OR m < 3 AND i = 1),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.y, c.r FROM c JOIN e ON e.x = c.doc_id)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, d.component_id FROM (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id) d LEFT JOIN z ON z.doc_id = d.doc_id"""


_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 2 - {k})) AS i FROM w)" for k in range(1, 6))
_CUTS = " UNION ALL ".join(f"SELECT lang, phrase, a, {c} AS c, array_to_string(w[1:{c}], ' ') AS lp, array_to_string(w[{c + 1}:k], ' ') AS rp FROM kept WHERE k > {c}" for c in range(1, 5))

COLLOCATIONS = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM ({_GRAMS}) GROUP BY lang, k, phrase),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND a >= 100),
sub AS (SELECT lang, array_to_string(w[1:k - 1], ' ') AS phrase, a FROM cand WHERE k > 2 UNION ALL SELECT lang, array_to_string(w[2:k], ' '), a FROM cand WHERE k > 2),
kept AS MATERIALIZED (SELECT * FROM cand WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.lang = cand.lang AND sub.phrase = cand.phrase AND sub.a >= cand.a)),
cuts AS ({_CUTS}),
sc AS (SELECT cuts.lang, cuts.phrase, cuts.a, c, x.a AS l, y.a AS r, n, (1000 * cuts.a::HUGEINT * n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = lp JOIN g y ON y.lang = cuts.lang AND y.phrase = rp JOIN t ON t.lang = cuts.lang),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM best
QUALIFY rank <= 2000"""


def lloyd(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Plain rounds: every part against every entry."""
    out = f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda e: floor(4096 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
pos AS (SELECT unnest(range({parts})) AS p),
parts AS MATERIALIZED (SELECT vec_id, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS x FROM kept, pos),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < {entries})"""
    gap = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(rounds + 1):
        out += f""",
d{r} AS (SELECT vec_id, a.p, e, x, {gap} AS d FROM parts a JOIN b{r} b ON a.p = b.p),
a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)"""
        if r < rounds:
            out += f""",
s{r} AS (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY p, e, i),
m{r} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)"""
    return out + f""",
o AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT o.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN kept ON kept.vec_id = o.vec_id, h"""


def oracle_sql() -> dict[str, str]:
    return {"op1_phrases": PHRASES, "op6_quality": quality.oracle_sql(), "op8_jaccard": JACCARD, "op11_heap_lloyd": lloyd(), "op12_collocations": COLLOCATIONS}

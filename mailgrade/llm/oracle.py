"""DuckDB SQL for the operators that SQL can express on whole tables."""

_WORDS = (
    r"[w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF w <> '']"
)



def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every part against every entry of its book, round by round."""
    nearest = """
a{r} AS MATERIALIZED (SELECT id, p, arg_min(e, far * 1000 + e) AS e, min(far) AS far
  FROM (SELECT v.id, v.p, b.e, list_sum([(v.x[i] - b.x[i]) * (v.x[i] - b.x[i]) FOR i IN range(1, len(v.x) + 1)])::BIGINT AS far
        FROM v JOIN b{r} b USING (p)) GROUP BY id, p)"""
    moved = """
s{r} AS (SELECT p, e, i, sum(y)::BIGINT AS t, count(*)::BIGINT AS n
  FROM (SELECT a.p, a.e, unnest(range(1, len(v.x) + 1)) AS i, unnest(v.x) AS y FROM a{r} a JOIN v USING (id, p)) GROUP BY p, e, i),
m{r} AS (SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY p, e),
b{next} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)"""
    steps = ",".join(nearest.format(r=r) + "," + moved.format(r=r, next=r + 1) for r in range(rounds))
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label,
    [floor(4096 * c::DOUBLE)::BIGINT FOR c IN embedding] AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR isnan(c) OR isinf(c)]) = 0),
v AS MATERIALIZED (SELECT id, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x
  FROM (SELECT id, x, unnest(range({parts})) AS p FROM k)),
b0 AS MATERIALIZED (SELECT p, id AS e, x FROM v WHERE id < {entries}),{steps},{nearest.format(r=rounds)},
codes AS MATERIALIZED (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY id),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM codes JOIN k USING (id) GROUP BY label)
SELECT k.vec_id, code, error, label_error, codebooks_sha256
FROM codes JOIN k USING (id) JOIN l ON l.label IS NOT DISTINCT FROM k.label CROSS JOIN books
"""


ORACLE: dict[str, str] = {
    "op13_vector_codes": _vector_codes(),
    # Every window of an item as one string, joined to every run of as many document words.
    "op8_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS span FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, span, array_to_string(w[i + 1 : i + span], ' ') AS g
            FROM (SELECT item_id, span, w, unnest(range(0, len(w) - span + 1)) AS i FROM items)),
spans AS (SELECT DISTINCT span FROM items),
runs AS (SELECT doc_id, span, i, array_to_string(w[i + 1 : i + span], ' ') AS g
         FROM (SELECT doc_id, w, span, unnest(range(0, len(w) - span + 1)) AS i FROM d, spans WHERE len(w) >= span)),
met AS (SELECT doc_id, i, r.span, item_id FROM runs r JOIN windows USING (span, g)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + span)) AS place FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    # Every 50-byte string with the least document that holds it; covered bytes are merged into runs.
    "op2_suffix_array_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, hex(b[i + 1 : i + 50]) AS g
      FROM (SELECT doc_id, b, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING count(*) > 1),
c AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE least < doc_id),
r AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
      FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -51) AS before FROM c)),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM s GROUP BY doc_id),
e AS (SELECT doc_id, n, b, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed,
             list_prepend(0, coalesce(z, [])) AS x, list_append(coalesce(a, []), n) AS y FROM d LEFT JOIN k USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(from_hex(array_to_string([hex(b[x[j] + 1 : y[j]]) FOR j IN range(1, len(x) + 1)], ''))) AS kept_sha256
FROM e
""",
}

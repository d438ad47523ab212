"""DuckDB twins of the numbered queries that SQL can express."""

from barloom.llm.common import LOWER, UPPER

_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TOKEN}') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1:i + k], ' ') AS t FROM bi),
d AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TOKEN}') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM bw),
dp AS (SELECT row_id, k, w, unnest(range(0, len(w) - k + 1)) AS i FROM d JOIN ks ON len(w) >= k),
dw AS (SELECT row_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS t FROM dp),
hits AS (SELECT DISTINCT row_id, i, dw.k, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.k = bw.k),
words AS (SELECT DISTINCT row_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT row_id, i, k FROM hits)),
nh AS (SELECT row_id, count(*) AS n_hit FROM words GROUP BY 1),
it AS (SELECT row_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s
       FROM hits GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN nh USING (row_id) LEFT JOIN it USING (row_id)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
i AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM i a JOIN i b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT s.doc_id, CAST(len(any_value(g)) AS BIGINT) AS n_shingles, min(reached) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id
"""

#: crc32 of a text of code points below U+0800, byte by byte, from a table of the 256 byte values.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_BYTES = """flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)]
    ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))"""

SPELLING = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: {_STEP}) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS k, concat(doc_id, ':', run) AS s FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}::BIGINT[]),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM own, crc),
words AS MATERIALIZED (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word,
    CAST(sum(k) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(k) >= 3),
cuts AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, CAST(i + 2 AS BIGINT)) AS cut FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word AS word, b.word AS near FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.cut = w.word UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.cut = w.word),
ranked AS (SELECT p.word, near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
    row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, near) AS place FROM pairs p JOIN words w ON p.near = w.word),
judged AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
    CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN ranked r ON w.word = r.word AND place = 1),
up(word, root, depth) AS (SELECT word, word, 0 FROM judged UNION ALL SELECT up.word, j.form, depth + 1 FROM up JOIN judged j ON up.root = j.word WHERE j.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, depth) AS root FROM up GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM judged JOIN roots USING (word)
"""


def _lloyd(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256) -> str:
    """Rounds of plain assignment and floored means, written out one after another."""
    steps = []
    for t in range(rounds + 1):
        steps.append(
            f"""d{t} AS (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN c{t} USING (i) GROUP BY r, c),
a{t} AS MATERIALIZED (SELECT r, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        )
        if t < rounds:
            steps.append(
                f"""m{t} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN x USING (r) GROUP BY c, i),
c{t + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{t} LEFT JOIN m{t} USING (c, i))"""
            )
    return f"""
WITH p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
x AS MATERIALIZED (SELECT r, unnest(range({dims})) AS i, unnest(v) AS x FROM p),
s AS (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c, v FROM p),
c0 AS MATERIALIZED (SELECT c, unnest(range({dims})) AS i, unnest(v) AS y FROM s WHERE c < {k}),
{','.join(steps)},
e AS (SELECT c, sum(d) AS cluster_inertia, sum(sum(d)) OVER () AS inertia FROM a{rounds} GROUP BY c),
h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(cluster_inertia AS BIGINT) AS cluster_inertia, CAST(inertia AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN p USING (r) JOIN e USING (c) JOIN h USING (c)
"""


ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": JACCARD,
    "op6_decontaminate": DECONTAMINATE,
    "op11_spelling_variants": SPELLING,
    "op13_heap_centroids": _lloyd(),
}

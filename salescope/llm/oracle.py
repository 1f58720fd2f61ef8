"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .license_scan import BLOCK_WORDS, PHRASES, TEMPLATES, THRESHOLD
from .line_dedup import EDIT_WORDS, EVERY_LINE

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UP}', '{_LOW}')"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def license_scan() -> str:
    """Phrases at every place, and every window against every template (the
    best window can be moved on to start with a word of some template)."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = " UNION ALL ".join(f"SELECT {_list(p.split())} AS ws, '{label}' AS label" for p, label in PHRASES)
    templates = " UNION ALL ".join(f"SELECT {_list(sorted(set(t.split())))} AS ws, '{label}' AS label" for t, label in TEMPLATES)
    vocabulary = _list(sorted({w for t, _ in TEMPLATES for w in t.split()}))
    return f"""
WITH phrase AS ({phrases}), template AS ({templates}),
d AS (SELECT doc_id, row_number() OVER () AS rid, {_lower('text')} AS t FROM documents),
w AS (SELECT doc_id, rid, regexp_extract_all(t, '{word}') AS ws FROM d),
place AS (SELECT rid, label, unnest(list_filter(range(0, len(w.ws)), lambda i: w.ws[i + 1:i + len(p.ws)] = p.ws)) AS pos
          FROM w, phrase p),
base AS (SELECT rid, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM place GROUP BY rid),
block AS (SELECT rid, list_filter(ws[s + 1:s + {BLOCK_WORDS}], lambda x: list_contains({vocabulary}, x)) AS ws FROM (
            SELECT rid, ws, unnest(list_filter(range(0, len(ws)), lambda i: list_contains({vocabulary}, ws[i + 1]))) AS s FROM w)),
share AS (SELECT rid, label, len(list_intersect(list_distinct(b.ws), t.ws)) AS n, len(t.ws) AS size FROM block b, template t),
hit AS (SELECT rid, label, n / size AS c FROM share WHERE n >= ceil({THRESHOLD} * size - 1e-9)),
best AS (SELECT rid, max(c) AS c FROM hit GROUP BY rid),
named AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (
            SELECT rid, label FROM place UNION SELECT rid, label FROM hit) GROUP BY rid),
base_named AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT rid, label FROM place) GROUP BY rid)
SELECT doc_id, len(w.ws) AS n_words, coalesce(base.n, 0) AS n_base, base.lo AS first_word, base.hi AS last_word,
       coalesce(base_named.labels, '') AS base_labels, coalesce(named.labels, '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best.c, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN best USING (rid) LEFT JOIN named USING (rid) LEFT JOIN base_named USING (rid)
"""


_COMPONENTS = """
reach AS (SELECT a AS node, b AS other FROM link
          UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other)
"""

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_lower('text')}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
                     FROM documents),
shingle AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                                  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id
           GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
         WHERE 100 * common.n >= 80 * (p.n + q.n - common.n)),
{_COMPONENTS},
least AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(other, d.doc_id)) AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN least ON least.node = d.doc_id
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
             AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
         WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{_COMPONENTS},
least AS (SELECT node, min(other) AS other FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, least(d.vec_id, coalesce(other, d.vec_id)) AS component_id,
       d.vec_id = least(d.vec_id, coalesce(other, d.vec_id)) AS kept
FROM embeddings d LEFT JOIN n ON n.a = d.vec_id LEFT JOIN least ON least.node = d.vec_id
"""

LINE_DEDUP = f"""
WITH raw AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS t
             FROM (SELECT doc_id, string_split({_lower('text')}, chr(10)) AS ls FROM documents)),
line AS (SELECT doc_id, line, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM raw),
used AS (SELECT doc_id, line, ws, array_to_string(ws, ' ') AS s, min({{'d': doc_id, 'l': line}}) OVER (PARTITION BY ws) AS fst
        FROM line WHERE len(ws) >= {EVERY_LINE}),
class AS (SELECT DISTINCT s, ws, fst FROM used WHERE len(ws) >= {EDIT_WORDS}),
variant AS (SELECT s, fst, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS v
            FROM (SELECT s, ws, fst, unnest(range(1, len(ws) + 1)) AS i FROM class)),
pair AS (SELECT x.s, y.fst AS partner FROM variant x JOIN variant y ON x.v = y.v AND x.i = y.i AND y.fst < x.fst
         UNION ALL SELECT x.s, y.fst FROM variant x JOIN class y ON x.v = y.s AND y.fst < x.fst
         UNION ALL SELECT x.s, y.fst FROM class x JOIN variant y ON y.v = x.s AND y.fst < x.fst),
near AS (SELECT s, min(partner) AS partner FROM pair GROUP BY s),
gone AS (SELECT doc_id, line, CASE WHEN partner IS NULL THEN fst ELSE least(fst, partner) END AS o,
                CASE WHEN partner < fst THEN 1 ELSE 0 END AS edits
         FROM used LEFT JOIN near USING (s) WHERE partner IS NOT NULL OR fst <> {{'d': doc_id, 'l': line}}),
listed AS (SELECT doc_id, count(*) AS n, string_agg(concat_ws(':', line, o.d, o.l, edits), ',' ORDER BY line) AS dropped
         FROM gone GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM used GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(x.n, 0) AS n_dropped, coalesce(x.dropped, '') AS dropped
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN listed x USING (doc_id)
"""

def _crc_table() -> str:
    """The 256 remainders of the checksum's polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(str(c))
    return "[" + ", ".join(out) + "]"


SPELLING = f"""
WITH RECURSIVE crc AS (SELECT {_crc_table()}::BIGINT[] AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all({_lower('text')}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r GROUP BY doc_id, run),
h AS (SELECT run, c, xor(4294967295, list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
                 lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)) AS h FROM u, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, c FROM h),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM w WHERE len(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS d FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v)),
pair AS (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.d = y.d AND x.i = y.i AND x.word <> y.word
         UNION SELECT x.word, y.word FROM cut x JOIN v y ON x.d = y.word
         UNION SELECT y.word, x.word FROM cut x JOIN v y ON x.d = y.word),
near AS (SELECT a AS word, count(*) AS n_near, min({{'m': -n, 'w': b}}) AS best FROM pair JOIN v ON v.word = b GROUP BY a),
formed AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * v.n THEN best.w END AS form,
                  CASE WHEN -best.m >= 2 * v.n THEN -best.m END AS form_n FROM v LEFT JOIN near USING (word)),
walk AS (SELECT word, form AS goal FROM formed WHERE form IS NOT NULL
         UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.goal WHERE formed.form IS NOT NULL),
ends AS (SELECT walk.word, goal FROM walk JOIN formed ON formed.word = walk.goal WHERE formed.form IS NULL)
SELECT formed.word, form, coalesce(ends.goal, formed.word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends ON ends.word = formed.word
"""


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Assignment and moving of entries, spelled out for every round."""
    ok = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [f"b0 AS (SELECT p, r - 1 AS k, x FROM part WHERE r <= {entries})"]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min({{'d': d, 'k': k}}) AS best FROM (
  SELECT r, part.p, part.x, k, list_sum(list_transform(range(1, len(part.x) + 1), lambda i: (part.x[i] - b.x[i]) * (part.x[i] - b.x[i])))::BIGINT AS d
  FROM part JOIN b{i} b ON part.p = b.p) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT p, k, list(f ORDER BY i) AS x FROM (
  SELECT p, best.k AS k, i, floor(sum(v) / count(*))::BIGINT AS f FROM (
    SELECT p, best, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY p, best.k, i) GROUP BY p, k),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.k = b.k)""")
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE {ok}),
width AS (SELECT greatest(1, ceil(max(len(x)) / {parts})::BIGINT) AS d FROM e),
part AS MATERIALIZED (SELECT r, p, list_resize(x, d * {parts}, 0)[p * d + 1:(p + 1) * d] AS x FROM e, width, range({parts}) t(p)),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(v, ',' ORDER BY p, k, i)) AS s FROM (
           SELECT p, k, unnest(x)::VARCHAR AS v, generate_subscripts(x, 1) AS i FROM b{rounds})),
total AS (SELECT label, sum(error)::BIGINT AS s FROM e JOIN coded USING (r) GROUP BY label)
SELECT vec_id, code, error, total.s AS label_error, book.s AS codebooks_sha256
FROM e JOIN coded USING (r) JOIN total ON total.label IS NOT DISTINCT FROM e.label, book
"""


VECTOR_CODES = vector_codes()

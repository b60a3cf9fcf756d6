"""SQL that gives the rows of the queries which SQL can express, for the smaller tables.

Long columns that may be null are cast to DOUBLE here, since that is how a frame of the queries' rows shows them.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([CAST(i AS UBIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda v, x: xor(v >> 1, (v & 1) * 3988292384)) AS v FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    """crc32 of a text whose characters have one or two bytes of UTF-8; needs ``crc`` among the tables."""
    return f"""xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], flatten(list_transform(string_split({text}, ''), lambda c:
        CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS UBIGINT)] ELSE [CAST(192 | (ord(c) >> 6) AS UBIGINT), CAST(128 | (ord(c) & 63) AS UBIGINT)] END))),
        lambda s, b: xor(s >> 8, crc.t[CAST((xor(s, b) & 255) + 1 AS BIGINT)])), CAST(4294967295 AS UBIGINT))"""


TOP_K = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings),
         s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

NEAR_DUPLICATES = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
         s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
               FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
         n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
         common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
         link AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
         reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
         low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.low, d.doc_id)) AS component_id,
        d.doc_id <= coalesce(low.low, d.doc_id) AS kept
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""

REPEATS = rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
         windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS content
                     FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
         later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
         gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
         words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM w),
         kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
    FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

SPELLING = f"""
    WITH RECURSIVE {_CRC_TABLE},
         runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
                  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
         hashed AS (SELECT run, n, {_crc("(doc_id || ':' || run)")} AS h FROM runs, crc),
         words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0
                       THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed)
                   WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
         cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
         pairs AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                   UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
         near AS (SELECT p.word, count(*) AS n_near, arg_min(near, (-n, near)) AS best, max(n) AS most FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
         forms AS MATERIALIZED (SELECT w.word, CASE WHEN most >= 10 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN most END AS form_n
                   FROM words w LEFT JOIN near ON near.word = w.word),
         steps(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, s.root, f.n, f.n_near, CAST(f.form_n AS DOUBLE) AS form_n
    FROM forms f JOIN steps s ON s.word = f.word JOIN forms e ON e.word = s.root AND e.form IS NULL
"""

PREFIX_TRIE = rf"""
    WITH {_CRC_TABLE},
         own AS MATERIALIZED (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns FROM conversations
                 WHERE conv_id IS NOT NULL GROUP BY conv_id),
         heads AS (SELECT conv_id, turns, CAST({_crc("CAST(conv_id AS VARCHAR)")} % 4 AS BIGINT) AS h FROM own, crc),
         rebuilt AS MATERIALIZED (SELECT c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h), []), list_slice(c.turns, h + 1, len(c.turns))) AS seq
                     FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
         prefixes AS (SELECT conv_id, len(seq) AS size, d, CAST(list_slice(seq, 1, d) AS VARCHAR) AS key, seq[d].t AS last,
                          CASE WHEN d > 0 THEN CAST(list_slice(seq, 1, d - 1) AS VARCHAR) END AS parent
                      FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
         nodes AS MATERIALIZED (SELECT key, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                       CASE WHEN any_value(d) > 0 THEN (count(*) - 1) * len(regexp_extract_all(any_value(last), '{_WORD}')) ELSE 0 END AS saved,
                       sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256 FROM prefixes GROUP BY key),
         children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
         above AS (SELECT DISTINCT p.key, q.key AS up FROM prefixes p JOIN prefixes q ON q.conv_id = p.conv_id AND q.d <= p.d),
         below AS (SELECT a.up AS key, count(*) FILTER (c.n IS NULL) AS n_leaves, sum(n.saved) AS saved
                   FROM above a JOIN nodes n ON n.key = a.key LEFT JOIN children c ON c.key = a.key GROUP BY a.up)
    SELECT n.conv_id, n.depth, CAST(p.conv_id AS DOUBLE) AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves,
        CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN below b ON b.key = n.key LEFT JOIN nodes p ON p.key = n.parent LEFT JOIN children c ON c.key = n.key
"""

ORACLES = {
    "op1_top_k": TOP_K,
    "op6_near_duplicates": NEAR_DUPLICATES,
    "op10_repeats": REPEATS,
    "op11_spelling": SPELLING,
    "op12_prefix_trie": PREFIX_TRIE,
}

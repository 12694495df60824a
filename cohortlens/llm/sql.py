"""DuckDB SQL of the queries that SQL can express."""

MIXING = r"""
WITH sized AS (
    SELECT doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
    FROM sized GROUP BY source
), limits AS (
    SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio,
        (sum(source_size) OVER ())::DOUBLE AS total
    FROM sources
), levels AS (
    SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY ratio, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM limits
), targets AS (
    SELECT source, source_size, least(cap, w * max(CASE WHEN level <= ratio THEN level END) OVER ()) AS target
    FROM levels
), budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
    FROM targets
), ranked AS (
    SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto
    FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
    (size * (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""

_LOWER = r"translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DOC_WORDS = (
    r"regexp_extract_all(" + _LOWER % "coalesce(text, '')" + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_DOC_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_DOC_WORDS} AS w FROM benchmark),
patterns AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS m,
        array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
    FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i)
    WHERE len(w) > 0
), lengths AS (SELECT DISTINCT m FROM patterns),
places AS (
    SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS p
    FROM docs, lengths, unnest(range(1, greatest(len(w) - m + 2, 1)::BIGINT)) AS r(i)
), found AS (SELECT doc_id, i, m, item_id FROM places JOIN patterns USING (m, p)),
hits AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_hit
    FROM (SELECT DISTINCT doc_id, i, m FROM found), unnest(range(0, m)) AS r(k) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
        string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM found GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

LINE_DEDUP = """
WITH docs AS (
    SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l
    FROM documents
), windows AS (
    SELECT doc_id, i, l[i : i + 2] AS lines
    FROM docs, unnest(range(1, greatest(len(l) - 1, 1)::BIGINT)) AS r(i)
), later AS (
    SELECT doc_id, i FROM windows
    QUALIFY row_number() OVER (PARTITION BY lines ORDER BY doc_id, i) > 1
), covered AS (
    SELECT DISTINCT doc_id, i + k AS i FROM later, unnest(range(0, 3)) AS r(k)
), spans AS (
    SELECT doc_id, count(*) AS n_removed, count(DISTINCT g) AS n_spans
    FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM covered)
    GROUP BY doc_id
), kept AS (
    SELECT d.doc_id, string_agg(d.l[r.i], chr(10) ORDER BY r.i) AS kept
    FROM docs d, unnest(range(1, len(l) + 1)) AS r(i)
    WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = d.doc_id AND c.i = r.i)
    GROUP BY d.doc_id
)
SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
    coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
    SELECT a AS x, a AS y FROM links
    UNION
    SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a
), found AS (
    SELECT x, min(y) AS y FROM reach GROUP BY x
), degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(y, vec_id) AS component_id,
    coalesce(y, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN found ON x = vec_id LEFT JOIN degrees ON a = vec_id
"""

LEXICAL_SEARCH = rf"""
WITH words AS (
    SELECT row_number() OVER () AS row, doc_id,
        regexp_extract_all({_LOWER % "coalesce(text, '')"}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), docs AS (
    SELECT row, doc_id, len(w)::BIGINT AS n FROM words WHERE len(w) > 0
), corpus AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        {_LOWER % "coalesce(text, '')"}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), held AS (
    SELECT row, term, count(*)::BIGINT AS tf
    FROM (SELECT row, unnest(w) AS term FROM words)
    WHERE term IN (SELECT term FROM asked) GROUP BY row, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
    FROM held, corpus GROUP BY term, big_n
), scored AS (
    SELECT item_id, doc_id, row,
        sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN docs USING (row), corpus
    GROUP BY item_id, doc_id, row
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row)::INT AS rank,
    doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

SPELLING = rf"""
WITH RECURSIVE steps AS (
    SELECT n, CASE WHEN k = 8 THEN c END AS entry
    FROM (
        SELECT n, 8 AS k, list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1
            THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT) AS c
        FROM range(256) AS r(n)
    )
), crc AS (SELECT list(entry ORDER BY n) AS entries FROM steps),
runs AS (
    SELECT doc_id, run, count(*)::BIGINT AS n
    FROM (SELECT doc_id, {_LOWER % "unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+'))"} AS run FROM documents)
    GROUP BY doc_id, run
), hashed AS (
    SELECT run, n, xor(list_reduce(
        flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE
            WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
            ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END)),
        lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
    FROM runs, crc
), harmed AS (
    SELECT CASE WHEN h % 97 = 0
        THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n
    FROM hashed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM harmed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), shorter AS (
    SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
    FROM words, unnest(range(1, length(word) + 1)) AS r(i)
), pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n
    FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION
    SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
    UNION
    SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word
), ranked AS (
    SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
        row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place
    FROM pairs
), forms AS (
    SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near,
        CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form,
        CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), follow AS (
    SELECT word, word AS at FROM forms
    UNION ALL
    SELECT f.word, g.form FROM follow f JOIN forms g ON f.at = g.word WHERE g.form IS NOT NULL
)
SELECT f.word, f.form, l.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN follow l ON l.word = f.word JOIN forms e ON e.word = l.at AND e.form IS NULL
"""

_MARKS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"]


def _escaped_length(text: str) -> str:
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for mark in _MARKS:
        out = f"replace({out}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
    return f"length({out})"


CHAT = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    sum({sum(map(len, _MARKS[:3]))} + {_escaped_length("role")} + {_escaped_length("text")})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

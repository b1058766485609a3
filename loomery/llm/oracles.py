"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from . import centroids, chat, embeddings, licenses, quality, quantised, vector_codes


def _text(value: str) -> str:
    """A string constant; control characters are spelt out."""
    parts = "".join(f"' || chr({ord(c)}) || '" if ord(c) < 32 else c.replace("'", "''") for c in value)
    return f"('{parts}')"


def _array(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def license_scan() -> str:
    """Words with their places; a phrase stands where the slice from its start equals it."""
    base = ", ".join(f"({_array(p.split())}, '{label}')" for p, label in licenses.BASE)
    templates = ", ".join(f"('{label}', {_array(t.split())}, {_array(k.split())}, {licenses._find(t.split(), k.split())})" for label, t, k in licenses.TEMPLATES)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
    base(phrase, label) AS (VALUES {base}),
    t(label, wording, phrase, off) AS (VALUES {templates}),
    places AS (SELECT rid, w, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
    b AS (SELECT rid, label, i FROM places, base WHERE word = phrase[1] AND w[i + 1:i + len(phrase)] = phrase),
    m AS (SELECT rid, label, len(list_filter(range(len(wording)), lambda k: i - off + k >= 0 AND w[i - off + k + 1] = wording[k + 1])) / greatest(len(wording), 8) AS score
          FROM places, t WHERE word = phrase[1] AND w[i + 1:i + len(phrase)] = phrase),
    bs AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY 1),
    ls AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM b UNION SELECT rid, label FROM m) GROUP BY 1),
    ms AS (SELECT rid, max(score) AS score FROM m GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(bs.labels, '') AS base_labels, coalesce(ls.labels, '') AS labels, coalesce(score, 0.0) AS score
    FROM d LEFT JOIN bs USING (rid) LEFT JOIN ls USING (rid) LEFT JOIN ms USING (rid)"""


def quality_rules() -> str:
    """Windows of three words are counted as they stand, and the places that they cover united."""
    space = _text(quality.SPACE)
    words = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    lines = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"
    bits = " | ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality.RULES)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {words} AS w, {lines} AS l FROM documents),
    win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
    keyed AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS k FROM win),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM keyed) WHERE n > 1),
    covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY 1),
    m AS (SELECT doc_id, len(w) AS n_words, length(translate(text, {space}, '')) AS word_chars, length(text) - length(translate(text, {_text(quality.SYMBOLS)}, '')) AS n_symbols,
          len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN covered USING (rid)),
    f AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {quality.mask(quality.BASE_RULES)} <> 0 AS base_failed, failed & {quality.mask(quality.POLICIES['v2'])} = 0 AS kept, n_lines, failed FROM f"""


def embedding_dedup() -> str:
    """All pairs of a label, and the least id reachable by breadth-first rounds."""
    return f"""
    WITH RECURSIVE fit AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fit x JOIN fit y ON x.label = y.label AND len(x.v) = len(y.v) AND x.rid <> y.rid
        WHERE list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) >= {embeddings.COSINE}),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM fit UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
    c AS (SELECT a, min(b) AS c FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
    SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(c.c, e.vec_id), true) AS kept
    FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""


def chat_formatting() -> str:
    """What is read back equals what was given, so the digests are those of the rows themselves."""
    said = "'\\### Assistant: </turn> ok'"
    escaped = "{}"
    for plain, code in chat.ESCAPES:
        escaped = f"replace({escaped}, {_text(plain)}, {_text(code)})"
    fixed = len(chat.OPEN) + len(chat.MID) + len(chat.CLOSE)
    order = "ORDER BY turn NULLS FIRST, role, e"
    return f"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said}),
    s AS (SELECT *, {escaped.format('text')} AS e, {escaped.format('role')} AS er FROM r),
    g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS whole,
        coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS loss, CAST(sum({fixed} + length(er) + length(e)) AS BIGINT) AS formatted_chars FROM s GROUP BY 1)
    SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


_FLOORS = "list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"
_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SQUARED = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
#: Floor of a sum over a count, also below zero.
_MEAN = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def centroid_clusters() -> str:
    """Lloyd's rounds over all rows one after the other, without multiplicities."""
    parts = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, {_FLOORS.format(scale=quantised.SCALE)} AS q FROM embeddings WHERE {_WHOLE} AND len(embedding) = 64)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS cluster, q AS c FROM (SELECT q, sha256('{centroids.SEED}:' || vec_id) AS h FROM k ORDER BY h, q LIMIT {centroids.CLUSTERS}))",
    ]
    for r in range(centroids.ROUNDS + 1):
        near = f"SELECT rid, cluster, {_SQUARED.format(a='q', b='c')} AS d FROM k, c{r}"
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM ({near}) GROUP BY 1)")
        if r < centroids.ROUNDS:
            means = f"SELECT cluster, list(m ORDER BY p) AS m FROM (SELECT cluster, p, {_MEAN} AS m FROM (SELECT cluster, unnest(range(64)) AS p, unnest(q) AS x FROM a{r} JOIN k USING (rid)) GROUP BY 1, 2) GROUP BY 1"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN ({means}) USING (cluster))")
    last = centroids.ROUNDS
    return f"""WITH {', '.join(parts)}
    SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(s AS BIGINT) AS cluster_inertia, CAST(t AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{last} JOIN k USING (rid) JOIN c{last} USING (cluster) JOIN (SELECT cluster, sum(d) AS s FROM a{last} GROUP BY 1) USING (cluster), (SELECT sum(d) AS t FROM a{last})"""


def vector_codes_sql() -> str:
    """Product quantisation of vectors of one length, each part against its codebook in turn."""
    n = vector_codes.PARTS
    parts = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, {_FLOORS.format(scale=quantised.SCALE)} AS q FROM embeddings WHERE {_WHOLE})",
        f"p AS MATERIALIZED (SELECT rid, part, q[part * w + 1:(part + 1) * w] AS q FROM (SELECT rid, q, len(q) // {n} AS w, unnest(range({n})) AS part FROM k))",
        f"s AS (SELECT rid, row_number() OVER (ORDER BY vec_id, q) - 1 AS entry FROM k ORDER BY vec_id, q LIMIT {vector_codes.ENTRIES})",
        "c0 AS MATERIALIZED (SELECT part, entry, q AS c FROM p JOIN s USING (rid))",
    ]
    for r in range(vector_codes.ROUNDS + 1):
        near = f"SELECT rid, part, entry, {_SQUARED.format(a='q', b='c')} AS d FROM p JOIN c{r} USING (part)"
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM ({near}) GROUP BY 1, 2)")
        if r < vector_codes.ROUNDS:
            means = f"SELECT part, entry, list(m ORDER BY i) AS m FROM (SELECT part, entry, i, {_MEAN} AS m FROM (SELECT part, entry, unnest(range(len(q))) AS i, unnest(q) AS x FROM a{r} JOIN p USING (rid, part)) GROUP BY 1, 2, 3) GROUP BY 1, 2"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM c{r} LEFT JOIN ({means}) USING (part, entry))")
    last = vector_codes.ROUNDS
    return f"""WITH {', '.join(parts)},
    v AS (SELECT rid, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY 1)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
    FROM v JOIN k USING (rid), (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM c{last})"""

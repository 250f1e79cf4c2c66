"""SQL (DuckDB) for the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import quality

_WORDS = r"[^\x20\x09-\x0D]+"

EXACT = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
    r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS k, count(*) OVER (PARTITION BY h) AS n FROM d)
    SELECT doc_id, k AS keep_id, n AS group_size, doc_id = k AS kept, h AS text_sha256 FROM r"""

NEAR = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON m.doc_id = d.doc_id"""


def _limit(n: int) -> str:
    """The limit of n-grams of n words, as ``quality.limit_at`` gives it."""
    limit = quality.NGRAM_LIMITS[n]
    if not isinstance(limit, tuple):
        return repr(float(limit))
    level, doubling, most = limit
    return f"least({most!r}::DOUBLE, {level!r}::DOUBLE + {doubling!r}::DOUBLE * log2(greatest(n_words, {quality.LEVEL_WORDS}) / {quality.LEVEL_WORDS}::DOUBLE))"


def _gram(n: int) -> str:
    """n words from here on, NULL where the text ends before."""
    return " || ' ' || ".join(f"x{k}" for k in range(n))


QUALITY = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS l FROM documents),
    b AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS lines, coalesce(list_sum(list_transform(list_distinct(l), lambda x: length(x))), 0) AS once FROM d),
    p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
    q AS (SELECT doc_id, i, x AS x0, {", ".join(f"lead(x, {k}) OVER o AS x{k}" for k in range(1, max(quality.NGRAM_LIMITS)))} FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    g AS ({" UNION ALL ".join(f"SELECT doc_id, i, length(x0) AS c, {n} AS n, {_gram(n)} AS gram FROM q" for n in sorted({5, *quality.NGRAM_LIMITS}))}),
    h AS (SELECT doc_id, i, c, n, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, n, gram) > 1 AS twice FROM g),
    v AS (SELECT doc_id, c, n, coalesce(i - max(CASE WHEN twice THEN i END) OVER (PARTITION BY doc_id, n ORDER BY i) < n, false) AS inside FROM h),
    s AS (SELECT doc_id, coalesce(count(*) FILTER (inside AND n = 5), 0) AS n_repeat_words, {", ".join(f"coalesce(sum(c) FILTER (inside AND n = {n}), 0) AS c{n}" for n in quality.NGRAM_LIMITS)} FROM v GROUP BY 1),
    f AS (SELECT b.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed, {", ".join(f"coalesce(c{n}, 0) AS c{n}" for n in quality.NGRAM_LIMITS)} FROM b LEFT JOIN s USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND CASE WHEN lines > 0 THEN (lines - once) / lines::DOUBLE ELSE 0 END <= {quality.LINE_LIMIT!r}::DOUBLE AND {" AND ".join(f"c{n} / greatest(word_chars, 1)::DOUBLE <= {_limit(n)}" for n in quality.NGRAM_LIMITS)} AS kept FROM f"""

REPEATS = r"""
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS l FROM documents),
    w AS (SELECT doc_id, s, md5(l[s:s + 99]) AS k FROM (SELECT doc_id, l, unnest(range(1, greatest(octet_length(l) - 98, 1))) AS s FROM d)),
    late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
    bytes AS (SELECT doc_id, unnest(range(1, octet_length(l) + 1)) AS b, unnest(regexp_extract_all(hex(l), '..')) AS x FROM d),
    c AS (SELECT bytes.doc_id, b, x, coalesce(b - max(late.s) OVER (PARTITION BY bytes.doc_id ORDER BY b) < 100, false) AS gone FROM bytes LEFT JOIN late ON late.doc_id = bytes.doc_id AND late.s = b),
    e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY b), false) AS edge FROM c),
    r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (edge) AS n_spans, coalesce(string_agg(x, '' ORDER BY b) FILTER (NOT gone), '') AS kept FROM e GROUP BY 1)
    SELECT d.doc_id, octet_length(l)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""

PASSAGES = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
    s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
    late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM s) WHERE m < doc_id),
    x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
    c AS (SELECT x.doc_id, x.i, word, coalesce(x.i - max(late.i) OVER (PARTITION BY x.doc_id ORDER BY x.i) < 13, false) AS gone FROM x LEFT JOIN late ON late.doc_id = x.doc_id AND late.i = x.i),
    r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY 1)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""

SECRET_COUNTS = r"""
    SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS n_assign,
        len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

MIX_TARGETS = rf"""
    WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')))::BIGINT AS source_size FROM documents GROUP BY 1),
    n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s),
    w AS (SELECT *, [3e0, 1e0, 2e0][sid % 3 + 1] AS weight, 2e0 * source_size AS ceiling FROM n),
    l AS (SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ceiling / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w)
    SELECT source, source_size, round(greatest(0, least(ceiling, (SELECT max(level) FROM l) * weight)), 4) AS target FROM l"""

#: crc32 of doc_id as text, bit by bit.
_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"

LM_BASE = rf"""
    WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}'), ' ') AS w FROM documents),
    t AS (SELECT doc_id, held_out, unnest(w) AS x FROM d),
    c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
    n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
    SELECT t.doc_id, t.held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (n + v + 1)::DOUBLE)), 4) AS base_score FROM t LEFT JOIN c USING (x), n GROUP BY 1, 2"""

FILTER_AUDIT = rf"""
    WITH RECURSIVE walk AS (SELECT '' AS o UNION ALL SELECT o || x FROM walk, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
    steps AS (SELECT o, k AS step, o[k] AS letter, left(o, k - 1) AS earlier FROM walk, (SELECT unnest(range(1, 6)) AS k) WHERE length(o) = 5),
    d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
    f AS (SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad,
        (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM d),
    c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY 1, 2),
    x AS (SELECT *, contains(fails, letter) AS hit, translate(earlier, fails, '') <> earlier AS gone FROM c, steps),
    s AS (SELECT part, o, step, letter, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost FROM x GROUP BY 1, 2, 3, 4)
    SELECT part, o AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM s"""

_SHARE = "(1 + (1000000000::HUGEINT * ({} + 2)) // ({} + 2 * v))"

DIVERGENCE = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
    g AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, count(*) AS v, sum(total) AS ln FROM k GROUP BY 1),
    c AS (SELECT g.lang, g.source, k.term, k.total, count(w.term) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term GROUP BY 1, 2, 3, 4),
    z AS (SELECT lang, source, sum(n) AS gn FROM c GROUP BY 1, 2),
    p AS (SELECT lang, source, term, n, {_SHARE.format("n", "gn")} AS p, {_SHARE.format("total", "ln")} AS q FROM c JOIN z USING (lang, source) JOIN v USING (lang)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
    u AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 10"""

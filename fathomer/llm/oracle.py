"""The queries in DuckDB's SQL where it can express them, written independently of the operators."""

from __future__ import annotations

from fathomer.functions.xxh_sql import hash_long, text_hashes

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"'[^\x20\x09-\x0D]+'"

LINE_DEDUP = rf"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents),
    keyed AS (
        SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS k
        FROM lines),
    shared AS (
        SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
        GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
    judged AS (
        SELECT keyed.doc_id, pos, line, keeper IS NOT NULL AND keyed.doc_id <> keeper AS gone
        FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
"""

NEAR_DEDUP = rf"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORDS}) AS w FROM documents),
    placed AS (
        SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM words WHERE len(w) > 0),
    grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS gram FROM placed),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
        FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * m >= 80 * (x.n + y.n - m)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached AS (
        SELECT doc_id AS a, doc_id AS b FROM documents
        UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
    least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
    SELECT l.doc_id, coalesce(n, 0) AS n_shingles, component_id, l.doc_id = component_id AS kept
    FROM least l LEFT JOIN sizes s ON s.doc_id = l.doc_id
"""

WARC = r"""
    WITH hashed AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS hex
        FROM pages),
    digested AS (
        SELECT page_id, payload_bytes, translate(
                   to_base(('0x' || substr(hex, 1, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(hex, 11, 10))::BIGINT, 32, 8) ||
                   to_base(('0x' || substr(hex, 21, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(hex, 31, 10))::BIGINT, 32, 8),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
        FROM hashed),
    best AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM digested)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> best THEN best END AS refers_to, TRUE AS intact
    FROM best
"""

# -- benchmark decontamination -----------------------------------------------------------------

_FIVE = "array_to_string(w[i:i + least(5, n) - 1], ' ')"

#: Every window of an item's length is compared that shares enough shingles to be as similar as 0.8; the fingerprints, which
#: only find candidates, have no part in it.
DECONTAMINATION = rf"""
    WITH items AS (
        SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k
        FROM (SELECT item_id, regexp_extract_all(translate(text, {_LOWER}), {_WORDS}) AS w FROM benchmark WHERE text IS NOT NULL)
        WHERE len(w) > 0),
    item_grams AS (
        SELECT item_id, n, k, array_to_string(w[i:i + k - 1], ' ') AS g, array_to_string(w, ' ') AS whole
        FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM items)),
    weights AS (SELECT k, g, 1.0::DOUBLE / count(DISTINCT whole) AS weight FROM item_grams GROUP BY k, g),
    item_counts AS (SELECT item_id, n, k, g, count(*) AS m FROM item_grams GROUP BY ALL),
    item_sums AS (
        SELECT item_id, n, k, sum(m) AS total, sum(weight * m) AS heavy FROM item_counts JOIN weights USING (k, g) GROUP BY ALL),
    docs AS (
        SELECT doc_id, w, len(w) AS len
        FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORDS}) AS w FROM documents)),
    sizes AS (SELECT DISTINCT k FROM items),
    doc_grams AS (
        SELECT doc_id, len, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len - k + 2)) AS i FROM docs, sizes WHERE len >= k)),
    hits AS (
        SELECT d.doc_id, d.len, d.i, c.item_id, c.n, c.k, least(c.n, d.len) - c.k + 1 AS span
        FROM doc_grams d JOIN item_counts c ON c.k = d.k AND c.g = d.g),
    starts AS (
        SELECT doc_id, item_id, n, k, span, len, s, count(*) AS shared
        FROM (SELECT *, unnest(range(greatest(1, i - span + 1), least(i, len - k - span + 2) + 1)) AS s FROM hits)
        GROUP BY ALL),
    likely AS (
        SELECT * FROM starts JOIN item_sums USING (item_id, n, k)
        WHERE shared >= 0.8 / 1.8 * (span + total) - 1e-6 OR shared >= 0.8 * heavy - 1e-6),
    inside AS (
        SELECT l.doc_id, l.item_id, l.n, l.k, l.s, l.len, l.total, l.heavy, d.g, count(*) AS m
        FROM likely l JOIN doc_grams d ON d.doc_id = l.doc_id AND d.k = l.k AND d.i BETWEEN l.s AND l.s + l.span - 1
        GROUP BY ALL),
    sums AS (
        SELECT doc_id, a.item_id, a.n, s, len, total, heavy, sum(a.m) AS own,
               sum(least(a.m, coalesce(c.m, 0))) AS same, sum(weight * least(a.m, coalesce(c.m, 0))) AS shared,
               sum(CASE WHEN c.m IS NULL THEN a.m ELSE weight * a.m END) AS own_heavy
        FROM inside a LEFT JOIN item_counts c ON c.item_id = a.item_id AND c.n = a.n AND c.k = a.k AND c.g = a.g
        LEFT JOIN weights v ON v.k = a.k AND v.g = a.g
        GROUP BY ALL),
    alike AS (
        SELECT doc_id, item_id, n, s, len,
               greatest(coalesce(shared, 0) / (heavy + own_heavy - coalesce(shared, 0)), coalesce(same, 0) / (total + own - coalesce(same, 0))::DOUBLE) AS sim
        FROM sums)
    SELECT doc_id, item_id, round(sim, 6) AS similarity, s - 1 AS first_word, least(n, len) AS n_words
    FROM alike WHERE sim >= 0.8 - 1e-12
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, n ORDER BY round(sim, 12) DESC, s) = 1
"""

# -- quality rules -----------------------------------------------------------------------------


def quality_rules(buckets: int, shrink: float, threshold: float, max_trusted: int) -> str:
    """The base counts and the verdict; hashes are computed here anew, by the definition of XXH64."""
    pair = hash_long("b", hash_long("a", "42::UHUGEINT"))
    id_hash = hash_long("doc_id::UHUGEINT", "42::UHUGEINT")
    signed = "CASE WHEN h >= 9223372036854775808::UHUGEINT THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h::HUGEINT END"
    return rf"""
    WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    split AS (SELECT doc_id, text, regexp_extract_all(text, {_WORDS}) AS w FROM texts),
    placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
    vocabulary AS (SELECT DISTINCT word FROM placed),{text_hashes("vocabulary")},
    coded AS (SELECT doc_id, i, word, h FROM placed JOIN hashed USING (word)),
    neighbours AS (SELECT doc_id, h AS a, lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM coded),
    pair_hashes AS (SELECT a, b, {pair} AS h FROM (SELECT DISTINCT a, b FROM neighbours WHERE b IS NOT NULL)),
    grams AS (
        SELECT doc_id, (h % {buckets}::UHUGEINT)::BIGINT AS bucket FROM coded
        UNION ALL SELECT doc_id, (h % {buckets}::UHUGEINT)::BIGINT FROM neighbours JOIN pair_hashes USING (a, b)),
    ids AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
    trusted AS (
        SELECT doc_id FROM (SELECT doc_id, {signed} AS o FROM (SELECT doc_id, {id_hash} AS h FROM ids)) ORDER BY o, doc_id LIMIT {max_trusted}),
    counts AS (SELECT bucket, count(*) AS r, count(*) FILTER (doc_id IN (SELECT doc_id FROM trusted)) AS t FROM grams GROUP BY bucket),
    sums AS (SELECT sum(r)::DOUBLE AS r_all, sum(t)::DOUBLE AS t_all FROM counts),
    ratios AS (SELECT bucket, ln((t + {shrink}::DOUBLE) / (t_all * r / r_all + {shrink}::DOUBLE)) AS ratio FROM counts, sums),
    scores AS (SELECT doc_id, avg(ratio) AS score FROM grams JOIN ratios USING (bucket) GROUP BY doc_id),
    windows AS (
        SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)),
    twice AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
    covered AS (
        SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM windows SEMI JOIN twice USING (doc_id, g)) GROUP BY doc_id),
    lines AS (
        SELECT doc_id, count(*) - count(DISTINCT line) AS n
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, {_WORDS}) GROUP BY doc_id),
    base AS (
        SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
               len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
               coalesce(score, 0) AS score
        FROM split s LEFT JOIN lines l ON l.doc_id = s.doc_id LEFT JOIN covered c ON c.doc_id = s.doc_id LEFT JOIN scores r ON r.doc_id = s.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= {threshold}::DOUBLE AS kept
    FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
    """


# -- secret scans ------------------------------------------------------------------------------

def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_QUOTE = "[\"'']?"
_KINDS = (
    ("assign", rf"((?:{_NAMES}){_QUOTE}\x20*[:=]\x20*{_QUOTE}([A-Za-z0-9+/_.=-]+))", "length(inside) >= 12"),
    ("access", "((AKIA[A-Z0-9]+))", "length(found) >= 18"),
    ("hex", "(([0-9a-f]+))", "length(found) >= 16"),
)
_TOKEN = r"((eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*)"


def _spans(order: int, kind: str, pattern: str, keep: str) -> str:
    """Matches with the gap before each, so that lengths add up to places."""
    parts = ", ".join(f"unnest(regexp_extract_all(text, '(?s)(.*?){pattern}', {g})) AS {name}" for g, name in ((1, "gap"), (2, "found"), (3, "inside"), (4, "more"))[: 4 if "more" in keep else 3])
    return f"""
        SELECT doc_id, {order} AS o, '{kind}' AS kind, upto - length(found) AS a, upto AS b FROM (
            SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY i) AS upto
            FROM (SELECT doc_id, {parts}, generate_subscripts(regexp_extract_all(text, '(?s)(.*?){pattern}', 2), 1) AS i FROM texts))
        WHERE {keep}"""


def _json(part: str) -> str:
    """The JSON that a part of a token decodes to, as text; null if it does not."""
    plain = f"translate({part}, '-_', '+/')"
    text = f"TRY(decode(from_base64({plain} || repeat('=', (4 - length({part}) % 4) % 4))))"
    return f"CASE WHEN length({part}) % 4 <> 1 THEN CASE WHEN json_valid({text}) THEN {text} END END"


def secret_scan() -> str:
    """Base spans and signed tokens.  Encoded keys have nested binary lengths, which SQL does not follow; the driver's tables hold none."""
    signed = f"json_type({_json('inside')}) = 'OBJECT' AND json_type({_json('inside')}, '$.alg') = 'VARCHAR' AND json_type({_json('more')}) = 'OBJECT'"
    found = " UNION ALL ".join([*(_spans(o, *kind) for o, kind in enumerate(_KINDS)), _spans(len(_KINDS), "token", _TOKEN, signed)])
    listed = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o)"
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, _, _ in _KINDS)
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    spans AS ({found})
    SELECT d.doc_id, {counts}, sha256(coalesce({listed} FILTER (kind <> 'token'), '')) AS base_sha256, coalesce({listed}, '') AS spans
    FROM texts d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id
    """

"""The catalogue's queries in DuckDB's SQL, written independently of the plans."""

from __future__ import annotations

from fathomer.functions.text import STOPWORDS
from fathomer.functions.xxh_sql import text_hashes
from fathomer.plans import samples

_PATH = """CASE doc_id % 6 WHEN 0 THEN 'src/d' || doc_id || '.go' WHEN 1 THEN 'docs/d' || doc_id || '.go'
    WHEN 2 THEN 'vendor/d' || doc_id || '.go' WHEN 3 THEN 'rel' || doc_id || '/CHANGELOG.md'
    WHEN 4 THEN 'pkg/d' || doc_id || '_test.go' ELSE 'api/d' || doc_id || '.pb.go' END"""
_TIER = "CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 2 ELSE 4 END"
_WEIGHT = "CASE tier WHEN 2 THEN 0.85::DOUBLE WHEN 3 THEN 0.7::DOUBLE WHEN 4 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"

_TOK = r"toks AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents)"
_SYM = rf"""sym AS (
    SELECT doc_id AS id, source AS file, coalesce(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')[1], '') AS name,
           lang AS kind, text AS doc_comment, doc_id::INTEGER AS start_line, (doc_id + n_chars % 40)::INTEGER AS end_line,
           CASE WHEN doc_id % 3 = 0 THEN 'R' || (doc_id % 7) ELSE '' END AS receiver, {_TIER} AS source_tier
    FROM documents)"""
_BRIEF = "id, file, name, kind, start_line, source_tier"
_CALLS = """calls AS (
    SELECT DISTINCT a.l_partkey AS caller, b.l_partkey AS callee
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""
_COS = """q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
    cos AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS cosine FROM embeddings, q)"""


#: Tokens of the name and of the text, without marks.
_FOLDED = rf"""{_SYM}, toks AS (
    SELECT id, regexp_extract_all(strip_accents(lower(name)), '[\p{{L}}\p{{N}}]+') AS nm,
           regexp_extract_all(strip_accents(lower(coalesce(doc_comment, ''))), '[\p{{L}}\p{{N}}]+') AS t FROM sym)"""


def _bm25(counts: list[str], match: str, digits: int = 6, toks: str = _TOK, length: str = "len(t)") -> str:
    """Scores of all matches; ``counts`` are the phrases' counts over the tokens ``t``."""
    tfs = ", ".join(f"{c} AS tf{i}" for i, c in enumerate(counts))
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(counts)))
    part = "greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / average))"
    score = " + ".join(part.format(i=i) for i in range(len(counts)))
    return f"""{toks},
        tf AS (SELECT id, {length} AS dl, {tfs} FROM toks),
        fig AS (SELECT count(*) AS n, avg(dl) AS average, {dfs} FROM tf),
        hits AS (SELECT id, round({score}, {digits}) AS score, {score} AS exact FROM tf, fig WHERE {match})"""


def _term(term: str, tokens: str = "t") -> str:
    return f"len(list_filter({tokens}, lambda x: x = '{term}'))"


def _prefix(term: str, tokens: str = "t") -> str:
    return f"len(list_filter({tokens}, lambda x: starts_with(x, '{term}')))"


def _phrase(a: str, b: str) -> str:
    return f"len(list_filter(range(1, len(t)), lambda i: t[i] = '{a}' AND t[i + 1] = '{b}'))"


def _folded(counts: list[str], match: str) -> str:
    return _bm25(counts, match, toks=_FOLDED, length="len(t) + len(nm)")


_THREE = _bm25([_term("the"), _term("that"), _term("with")], "tf0 > 0 AND tf1 > 0 AND tf2 > 0")


def _semantic(wide: int, n: int) -> str:
    return f"""{_COS}, {_SYM},
    raw AS (SELECT vec_id, cosine FROM cos ORDER BY cosine DESC, vec_id LIMIT {wide}),
    weighted AS (
        SELECT id, name, kind, round(cosine * w, 6) AS score
        FROM raw JOIN (SELECT *, source_tier AS tier, {_WEIGHT.replace("tier", "source_tier")} AS w FROM sym) s ON s.id = vec_id),
    cut AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM weighted QUALIFY r <= {n}),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY name, kind ORDER BY r) AS nth FROM cut),
    semantic AS (SELECT id, score, row_number() OVER (ORDER BY r) AS rank FROM firsts WHERE nth = 1)"""


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)


def _reach(depth: int) -> str:
    return f"""WITH RECURSIVE {_CALLS},
        walk AS (
            SELECT p_partkey AS id, 0 AS hop FROM part WHERE p_partkey = 1
            UNION SELECT p.p_partkey, hop + 1 FROM walk w JOIN calls c ON c.caller = w.id JOIN part p ON p.p_partkey = c.callee WHERE hop < {depth})
        SELECT id, min(hop)::BIGINT AS hop FROM walk GROUP BY id"""


def _keys(files: str, symbols: str, embeddings: str, calls: str, imports: str) -> str:
    """The keys of the five tables under a condition each."""
    return f"""WITH {_SYM}
        SELECT 'files' AS "table", file AS key FROM (SELECT DISTINCT file FROM sym) WHERE {files}
        UNION ALL SELECT 'symbols', concat_ws('|', file, id) FROM sym WHERE {symbols}
        UNION ALL SELECT 'embeddings', vec_id::VARCHAR FROM embeddings LEFT JOIN sym ON id = vec_id WHERE {embeddings}
        UNION ALL SELECT 'call_edges', concat_ws('|', file, name, kind, start_line) FROM (SELECT DISTINCT file, name, kind, start_line FROM sym) WHERE {calls}
        UNION ALL SELECT 'import_edges', concat_ws('|', file, kind) FROM (SELECT DISTINCT file, kind FROM sym) WHERE {imports}"""


_OUT = "file NOT IN ('src1', 'src2')"


def _drawn(salt: str, low: int, high: int) -> str:
    return f"(('0x' || substr(md5('42:' || c_custkey || ':{salt}'), 1, 8))::BIGINT % {high - low + 1} + {low})"


_TREES = f"SELECT c_custkey AS k, {_drawn('types', 2, 4)} AS t, {_drawn('methods', 2, 4)} AS m, {_drawn('functions', 3, 7)} AS f FROM customer"


def _plain(x: str) -> str:
    for written, meant in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{written}', {meant})"
    return x


ORACLE_SQL = {
    "symbol_by_id": f"WITH {_SYM} SELECT {_BRIEF} FROM sym WHERE id = 7",
    "symbols_by_file": f"WITH {_SYM} SELECT {_BRIEF} FROM sym WHERE file = 'src3' ORDER BY start_line",
    "symbols_by_ids": f"WITH {_SYM} SELECT {_BRIEF} FROM sym WHERE id IN (3, 5, 8, 13, 21, 1000000000)",
    "symbols_by_names": f"WITH {_SYM} SELECT {_BRIEF} FROM sym WHERE name IN ('the', 'la', 'and')",
    "symbol_json": f"""WITH {_SYM} SELECT id, '{{"file":' || to_json(file) || ',"name":' || to_json(name) || ',"kind":' || to_json(kind)
        || ',"signature":"","lines":"' || start_line || '-' || end_line || '"' || CASE WHEN doc_comment <> '' THEN ',"doc":' || to_json(doc_comment) ELSE '' END
        || CASE WHEN receiver <> '' THEN ',"receiver":' || to_json(receiver) ELSE '' END || '}}' AS json FROM sym""",
    "id_build": f"""WITH {_SYM} SELECT id, file || ':' || CASE WHEN receiver <> '' THEN receiver || '.' ELSE '' END || name || ':' || kind
        AS symbol_id FROM sym""",
    "first_line": "SELECT doc_id, trim(split_part(split_part(coalesce(text, ''), chr(10), 1), '{', 1)) AS line FROM documents",
    "path_parts": rf"""SELECT doc_id, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS ext, regexp_extract(path, '[^/]*$') AS base
        FROM (SELECT doc_id, {_PATH} AS path FROM documents)""",
    "url_path": r"""SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path
        FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)""",
    "qualified_split": """SELECT p_partkey, list_extract(w, -1) AS last, array_to_string(w[:-2], '::') AS scope
        FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""",
    "extract_keywords": rf"""WITH found AS (
            SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:[-_.][a-z0-9]+)*') AS f FROM benchmark),
        kept AS (SELECT item_id, list_filter(f, lambda x: length(x) BETWEEN 3 AND 30 AND x NOT IN ({_STOP})) AS k FROM found)
        SELECT item_id, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i)[1:12], ' ') AS keywords FROM kept""",
    "source_tier": f"SELECT doc_id, tier, {_WEIGHT} AS weight FROM (SELECT doc_id, {_TIER} AS tier FROM documents)",
    "tier_histogram": f"SELECT tier, count(*) AS n FROM (SELECT {_TIER} AS tier FROM documents) GROUP BY tier",
    "tokenize_postings": f"""WITH {_TOK}, occ AS (SELECT id, len(t)::INTEGER AS dl, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM toks)
        SELECT term, id, count(*) AS tf, dl, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM occ GROUP BY term, id, dl""",
    "doc_stats": f"WITH {_TOK} SELECT id, len(t)::INTEGER AS dl FROM toks",
    "corpus_stats": f"WITH {_TOK} SELECT count(*) AS n, round(avg(len(t)), 6) AS avgdl FROM toks",
    "df_table": f"WITH {_TOK} SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(t) AS term FROM toks) GROUP BY term",
    "keyword_search": f"WITH {_THREE} SELECT id, score FROM hits",
    "keyword_scan": f"WITH {_THREE} SELECT id, score FROM hits",
    "keyword_default": f"""WITH {_folded([f"{_term('the')} + {_term('the', 'nm')}", f"{_prefix('cion')} + {_prefix('cion', 'nm')}"], "tf0 > 0 OR tf1 > 0")}
        SELECT id, score, row_number() OVER (ORDER BY exact DESC, id) AS rank FROM hits QUALIFY rank <= 50""",
    "keyword_column": f"""WITH {_folded([_term("the", "nm"), _term("of")], "tf0 > 0 AND tf1 > 0")} SELECT id, score FROM hits""",
    "keyword_first": f"""WITH {_folded(["coalesce((nm[1] = 'the')::INTEGER, 0) + coalesce((t[1] = 'the')::INTEGER, 0)", _phrase("que", "la")], "tf0 > 0 OR tf1 > 0")}
        SELECT hits.id, name, kind, score FROM hits JOIN sym ON sym.id = hits.id""",
    "keyword_top10": f"WITH {_THREE} SELECT id, row_number() OVER (ORDER BY exact DESC, id) AS rank FROM hits QUALIFY rank <= 10",
    "keyword_or": f"""WITH {_bm25([_term("thing"), _term("estiin"), _term("citación")], "tf0 > 0 OR tf1 > 0 OR tf2 > 0")} SELECT id, score FROM hits""",
    "keyword_not": f"""WITH {_bm25([_term("the"), _term("that")], "tf0 > 0 AND NOT tf1 > 0")} SELECT id, score FROM hits""",
    "keyword_prefix": f"""WITH {_bm25(["len(list_filter(t, lambda x: starts_with(x, 'thing')))"], "tf0 > 0")} SELECT id, score FROM hits""",
    "keyword_phrase": f"""WITH {_bm25([_phrase("of", "the")], "tf0 > 0")} SELECT id, score FROM hits""",
    "keyword_near": f"""WITH {_bm25([_term("with"), _term("that")], "tf0 > 0 AND tf1 > 0")},
        occ AS (SELECT id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM toks),
        near AS (SELECT DISTINCT a.id FROM occ a JOIN occ b ON a.id = b.id AND a.term = 'with' AND b.term = 'that' AND abs(a.pos - b.pos) - 1 <= 5)
        SELECT hits.id, score FROM hits JOIN near ON near.id = hits.id""",
    "cosine_all": f"WITH {_COS} SELECT vec_id, cosine FROM cos",
    "semantic_topk": f"""WITH {_COS} SELECT vec_id, cosine, row_number() OVER (ORDER BY cosine DESC, vec_id) AS rank FROM cos QUALIFY rank <= 10""",
    "semantic_tiered": f"WITH {_semantic(30, 10)} SELECT id, score, r AS rank FROM cut",
    "semantic_dedup": f"WITH {_semantic(30, 10)} SELECT id, score, rank FROM semantic",
    "knn_per_label": f"""WITH {_COS} SELECT label, vec_id, cosine, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rank
        FROM cos QUALIFY rank <= 3""",
    "search_quality": """WITH pairs AS (
            SELECT a.vec_id AS query, b.vec_id AS item, round(list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS cosine, (a.label = b.label)::INTEGER AS grade
            FROM embeddings a, embeddings b WHERE a.vec_id < 20 AND a.vec_id <> b.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, item) AS rank FROM pairs QUALIFY rank <= 10),
        useful AS (SELECT query, sum(grade) AS n, list_sum(list_transform(range(1, least(10, sum(grade)::BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM pairs GROUP BY query),
        got AS (SELECT query, sum(grade) AS n, min(rank) FILTER (grade = 1) AS first, sum(grade / log2(rank + 1)) AS gain FROM ranked GROUP BY query)
        SELECT u.query, round(g.n / 10.0::DOUBLE, 9) AS precision, round(CASE WHEN u.n > 0 THEN g.n / u.n ELSE 0 END, 9) AS recall,
               round(coalesce(1.0::DOUBLE / first, 0), 9) AS reciprocal, round(CASE WHEN u.n > 0 THEN gain / ideal ELSE 0 END, 9) AS ndcg
        FROM useful u JOIN got g ON g.query = u.query""",
    "hybrid_rrf": f"""WITH {_semantic(90, 30)}, {_THREE},
        words AS (SELECT id, row_number() OVER (ORDER BY exact DESC, id) AS rank FROM hits QUALIFY rank <= 30)
        SELECT coalesce(s.id, w.id) AS id, round(0.6::DOUBLE / (60 + coalesce(s.rank, 130)) + 0.4::DOUBLE / (60 + coalesce(w.rank, 130)), 9) AS score
        FROM semantic s FULL JOIN words w ON s.id = w.id""",
    "hybrid_dedup": f"""WITH {_semantic(90, 30)}, {_bm25(["0"], "FALSE")},
        fused AS (SELECT id, round(0.6::DOUBLE / (60 + rank) + 0.4::DOUBLE / 190, 9) AS score FROM semantic),
        best AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM fused QUALIFY r <= 10),
        named AS (SELECT best.*, row_number() OVER (PARTITION BY name, kind ORDER BY r) AS nth FROM best JOIN sym ON sym.id = best.id)
        SELECT id, row_number() OVER (ORDER BY r) AS rank FROM named WHERE nth = 1""",
    "rerank_call_graph": f"""WITH {_CALLS},
        top AS (SELECT p_partkey AS name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS i FROM part QUALIFY i < 60),
        pairs AS (SELECT caller, callee FROM calls WHERE caller IN (SELECT name FROM top) AND callee IN (SELECT name FROM top)),
        ends AS (SELECT caller AS name FROM pairs UNION ALL SELECT callee FROM pairs),
        counts AS (SELECT name, count(*) AS c FROM ends GROUP BY name)
        SELECT top.name, row_number() OVER (ORDER BY i - 2 * coalesce(c, 0), i) AS rank FROM top LEFT JOIN counts ON counts.name = top.name""",
    "callees": f"WITH {_CALLS} SELECT DISTINCT callee AS name FROM calls WHERE caller = 1",
    "callers": f"WITH {_CALLS} SELECT DISTINCT caller AS name FROM calls WHERE callee = 1",
    "blast_radius": f"WITH {_CALLS} SELECT p_partkey AS id, p_brand FROM part WHERE p_partkey IN (SELECT caller FROM calls WHERE callee = 1)",
    "connection_counts": f"""WITH {_CALLS}, pairs AS (SELECT * FROM calls WHERE caller IN (SELECT p_partkey FROM part)
            AND callee IN (SELECT p_partkey FROM part))
        SELECT name, count(*) AS connections FROM (SELECT caller AS name FROM pairs UNION ALL SELECT callee FROM pairs) GROUP BY name""",
    "traverse_d1": _reach(1),
    "traverse_d3": _reach(3),
    "call_lists": f"WITH {_CALLS} SELECT caller AS caller_symbol, string_agg(callee::VARCHAR, ',' ORDER BY callee) AS callees FROM calls GROUP BY caller",
    "missing_embeddings": "SELECT doc_id AS id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)",
    "incremental_skip": """SELECT doc_id::VARCHAR AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS content_hash
        FROM documents WHERE doc_id % 13 <> 0 AND (doc_id % 7 = 0 OR doc_id % 11 = 0)""",
    "reconcile_stale": "SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 = 0",
    "upsert_rows": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'REBUILT' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "delete_cascade": _keys(_OUT, _OUT, "file IS NULL OR " + _OUT, _OUT, _OUT),
    "delete_keep_edges": _keys(_OUT, _OUT, "file IS NULL OR " + _OUT, "TRUE", "TRUE"),
    "replace_by_file": _keys("TRUE", f"{_OUT} OR id % 2 = 0", f"{_OUT} OR id % 2 = 0", f"{_OUT} OR start_line % 2 = 0", f"{_OUT} OR kind = 'en'"),
    "edges_dedup_pk": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""",
    "embed_text": f"""WITH {_SYM}, {_CALLS},
        called AS (SELECT DISTINCT file, name, callee FROM calls JOIN sym ON sym.id = caller),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY callee) AS i FROM called),
        listed AS (SELECT file, name, string_agg(callee::VARCHAR, ', ' ORDER BY callee) AS c FROM ranked WHERE i <= 10 GROUP BY file, name),
        imported AS (SELECT file, string_agg(kind, ', ' ORDER BY kind) AS m FROM (SELECT DISTINCT file, kind FROM sym) GROUP BY file),
        parts AS (SELECT sym.*, c, m, trim(split_part(split_part(coalesce(doc_comment, ''), chr(10), 1), '{{', 1)) AS line, left(coalesce(doc_comment, ''), 80) AS snippet
            FROM sym LEFT JOIN listed ON listed.file = sym.file AND listed.name = sym.name LEFT JOIN imported ON imported.file = sym.file)
        SELECT id, file || ' ' || kind || ' ' || CASE WHEN receiver <> '' THEN receiver || '.' ELSE '' END || name
            || CASE WHEN line <> '' THEN chr(10) || line ELSE '' END || CASE WHEN snippet <> '' THEN chr(10) || snippet ELSE '' END
            || coalesce(chr(10) || 'calls: ' || c, '') || coalesce(chr(10) || 'imports: ' || m, '') AS text FROM parts""",
    "doc_symbol": """SELECT doc_id, left(array_to_string(string_split(text, chr(10))[1:5], chr(10)), 300) AS signature,
        md5(left(text, 4000)) AS doc_md5 FROM documents WHERE text <> ''""",
    "percentiles_nearest_rank": """SELECT p::DOUBLE AS p, list_sort(v)[greatest(ceil(len(v) * p / 100.0), 1)::BIGINT] AS value
        FROM (SELECT list(value) AS v FROM events WHERE value IS NOT NULL), (VALUES (50), (95), (99)) x(p)""",
    "latency_rollup": """SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS average
        FROM events GROUP BY event_type""",
    "debounce_sessions": """WITH steps AS (
            SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, TRUE)::INTEGER AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        bursts AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM steps)
        SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event
        FROM bursts GROUP BY user_id, b""",
    "index_counters": f"WITH {_SYM} SELECT count(DISTINCT file) AS files, count(*) AS symbols, count(*) FILTER (kind = 'en') AS en FROM sym",
    "route_files": rf"""SELECT doc_id, CASE WHEN doc_id % 9 = 1 THEN 'x/Makefile' ELSE path END AS path
        FROM (SELECT doc_id, {_PATH} AS path FROM documents) WHERE doc_id % 9 <> 0""",
    "ignore_filter": rf"""SELECT doc_id, path FROM (SELECT doc_id, {_PATH} AS path FROM documents)
        WHERE doc_id % 10 <> 0 AND path NOT LIKE 'vendor/%' AND (path NOT LIKE '%.pb.go' OR path = 'api/d5.pb.go')
          AND NOT regexp_matches(path, '^pkg/d1[^/]*_test\.go$')""",
    "vector_codec": """SELECT vec_id AS symbol_id, (4 * len(embedding))::INTEGER AS bytes, round(embedding[1]::DOUBLE, 6) AS head,
        round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""",
    "html_symbols": rf"""WITH found AS (
            SELECT page_id, 'element' AS kind, unnest(regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1)) AS x FROM pages
            UNION ALL SELECT page_id, 'section', unnest(regexp_extract_all(html, '(?is)<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]\s*>', 1)) FROM pages)
        SELECT DISTINCT 'p' || page_id || '.html' AS file, trim({_plain("x")}) AS name, kind FROM found WHERE trim(x) <> ''""",
    "content_hashes": f"""WITH RECURSIVE texts AS (SELECT DISTINCT text AS word FROM documents WHERE text IS NOT NULL),{text_hashes("texts", seed=0)}
        SELECT doc_id, lower(hex(h::UBIGINT)) AS content_hash FROM documents LEFT JOIN hashed ON word = text""",
    "embed_documents": r"""WITH split AS (
            SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[\p{L}\p{N}]+')) AS tok FROM documents),
        hashed AS (SELECT doc_id, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS h FROM split),
        sums AS (SELECT doc_id, h % 32 AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS v FROM hashed GROUP BY ALL),
        norms AS (SELECT doc_id, sqrt(sum(v * v)::DOUBLE) AS norm FROM sums GROUP BY doc_id)
        SELECT doc_id AS symbol_id, 'hashing' AS model, 32 AS dims, place, round((v / norm)::FLOAT::DOUBLE, 5) AS value FROM sums JOIN norms USING (doc_id) WHERE v <> 0""",
    "embed_cached": """WITH RECURSIVE asked AS (SELECT list(r_regionkey % 3 ORDER BY r_regionkey) AS one FROM region),
        full_ AS (SELECT one || one AS q FROM asked),
        walk AS (
            SELECT 0::BIGINT AS step, []::BIGINT[] AS known, 0::BIGINT AS asked
            UNION ALL SELECT step + 1,
                CASE WHEN list_contains(known, q[step + 1]) THEN known WHEN len(known) >= 2 THEN known[2:] || [q[step + 1]::BIGINT] ELSE known || [q[step + 1]::BIGINT] END,
                asked + CASE WHEN list_contains(known, q[step + 1]) THEN 0 ELSE 1 END
            FROM walk, full_ WHERE step < len(q))
        SELECT step, q[step]::BIGINT AS query, asked FROM walk, full_ WHERE step > 0""",
    "synthetic_trees": f"""WITH trees AS ({_TREES})
        SELECT 'pkg' || k % 10 || '/file' || k || '.go' AS path, t AS struct, t * m AS method, f AS function, t * m + f - 1 AS calls FROM trees
        UNION ALL SELECT 'pkg' || k % 10 || '/file' || k || '.java', t + 1, t * m + f, 0, t * m + f - 1 FROM trees""",
    "search_dispatch": f"""WITH {_semantic(90, 30)}, {_bm25([_term("ing"), _term("tion")], "tf0 > 0 AND tf1 > 0")},
        words AS (SELECT id, row_number() OVER (ORDER BY exact DESC, id) AS rank FROM hits QUALIFY rank <= 30),
        fused AS (
            SELECT coalesce(s.id, w.id) AS id, round(0.6::DOUBLE / (60 + coalesce(s.rank, 130)) + 0.4::DOUBLE / (60 + coalesce(w.rank, 130)), 6) AS score
            FROM semantic s FULL JOIN words w ON s.id = w.id),
        best AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM fused QUALIFY r <= 10),
        named AS (SELECT best.*, name, row_number() OVER (PARTITION BY name, kind ORDER BY r) AS nth FROM best JOIN sym ON sym.id = best.id),
        top AS (SELECT id, name, row_number() OVER (ORDER BY r) - 1 AS i FROM named WHERE nth = 1),
        pairs AS (SELECT DISTINCT a.name AS caller, b.name AS callee FROM sym a JOIN sym b ON b.id = a.id + 1
            WHERE a.name IN (SELECT name FROM top) AND b.name IN (SELECT name FROM top)),
        ends AS (SELECT caller AS name FROM pairs UNION ALL SELECT callee FROM pairs),
        counts AS (SELECT name, count(*) AS c FROM ends GROUP BY name)
        SELECT id, row_number() OVER (ORDER BY i - 2 * coalesce(c, 0), i) AS rank FROM top LEFT JOIN counts ON counts.name = top.name""",
    "stored_tables": _keys(_OUT, _OUT, _OUT, _OUT, _OUT).replace("concat_ws('|', file, id)", "concat_ws('|', file, file || ':' || id)").replace("vec_id::VARCHAR", "file || ':' || vec_id"),
    "stored_hash": "SELECT '7' AS path, md5(text) AS content_hash FROM documents WHERE doc_id = 7 UNION ALL SELECT 'none', ''",
    "store_backfill": """SELECT source || ':' || doc_id AS symbol_id, 'm' AS model, CASE WHEN vec_id IS NULL THEN 8 ELSE len(embedding) END AS size
        FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    "index_run": f"""WITH found AS ({samples.sql("java")}),
        runs AS (SELECT count(DISTINCT path) AS files, count(*) AS n, count(DISTINCT path) FILTER (path LIKE '%0.java') AS changed, count(*) FILTER (path LIKE '%0.java') AS m FROM found WHERE what = 'symbol')
        SELECT path AS file, name, kind FROM found WHERE what = 'symbol'
        UNION ALL SELECT DISTINCT path, 'Added', 'struct' FROM found WHERE path LIKE '%0.java'
        UNION ALL SELECT path, owner || '>' || name, 'call' FROM found WHERE what = 'call'
        UNION ALL SELECT 'run 0', files::VARCHAR, n::VARCHAR FROM runs UNION ALL SELECT 'run 1', changed::VARCHAR, (m + changed)::VARCHAR FROM runs UNION ALL SELECT 'run 2', '0', '0'""",
    "embed_without_model": "SELECT doc_id AS symbol_id, 'none' AS model, 4 AS dims, 0.0::DOUBLE AS total FROM documents",
    "embed_one_by_one": "SELECT doc_id AS symbol_id, length(doc_id::VARCHAR)::INTEGER AS length FROM documents WHERE doc_id % 10 <> 3",
} | {f"{language}_symbols": samples.sql(language) for language in samples.SAMPLES}

"""DuckDB SQL that gives the same rows as the queries of ``registry``, written independently of them."""

from __future__ import annotations

from tarn.operators import answering

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

STORE = """store AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, chunk_no DESC) AS r
    FROM chunks WHERE chunk_id IS NOT NULL) WHERE r = 1)"""
LOGGED = """logged AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, rank_no ORDER BY logged_at DESC NULLS LAST) AS r FROM retrieved) WHERE r = 1)"""
LISTED = "listed AS (SELECT document_title AS title, document_url AS url FROM (SELECT *, row_number() OVER (PARTITION BY document_url ORDER BY chunk_index DESC) AS n FROM store) WHERE n = 1)"
TOKENS = "tokens AS (SELECT chunk_no, document_url, chunk_index, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM store)"
POSTINGS = "postings AS (SELECT chunk_no, document_url, chunk_index, n, term, count(*) AS tf FROM (SELECT * EXCLUDE (w), len(w) AS n, unnest(w) AS term FROM tokens) GROUP BY ALL)"
STATS = "stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean FROM tokens)"
IDF = "idf AS (SELECT term, count(*) AS df, ln((n_docs - count(*) + 0.5e0) / (count(*) + 0.5e0) + 1e0) AS idf FROM postings, stats GROUP BY term, n_docs)"
NETLOC = "regexp_extract({}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[{WS}]+'), lambda w: w <> '')"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _bm25(k: int) -> str:
    return f"""{STORE}, {TOKENS}, {POSTINGS}, {STATS}, {IDF},
        asked AS (SELECT id AS question_id, unnest(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+'))) AS term FROM eval_set),
        scored AS (SELECT question_id, document_url, chunk_index, round(sum(idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * n / mean))), 6) AS bm25
            FROM asked JOIN postings USING (term) JOIN idf USING (term), stats GROUP BY ALL),
        keyword AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, document_url, chunk_index) AS rank FROM scored) WHERE rank <= {k})"""


_COSINE = "round(CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0 ELSE list_cosine_similarity({a}, {b}) END, 6)"


def _vector(k: int) -> str:
    similarity = _COSINE.format(a="s.e", b="q.e")
    return f"""vectors AS (SELECT *, embedding::DOUBLE[] AS e FROM store WHERE len(embedding) = 64),
        asked_vectors AS (SELECT id AS question_id, m.embedding::DOUBLE[] AS e FROM eval_set JOIN embeddings m ON vec_id = id),
        vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, document_url, chunk_index) AS rank FROM
            (SELECT question_id, document_url, chunk_index, {similarity} AS similarity FROM asked_vectors q, vectors s)) WHERE rank <= {k})"""


_RRF = """fused AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, vector_rank NULLS LAST, document_url, chunk_index) AS rank FROM
    (SELECT question_id, document_url, chunk_index, v.rank AS vector_rank, k.rank AS keyword_rank, round(coalesce(1e0 / (60 + v.rank), 0) + coalesce(1e0 / (60 + k.rank), 0), 12) AS rrf
        FROM vector v FULL JOIN keyword k USING (question_id, document_url, chunk_index)))"""
_TIER = "CASE WHEN similarity >= 0.35 THEN 'accepted' WHEN similarity >= 0.33 THEN 'related' END"


def _tiers(ranked: str) -> str:
    return f"SELECT question_id::BIGINT AS question_id, document_url, chunk_index::BIGINT AS chunk_index, similarity, rank, {_TIER} AS tier FROM ({ranked}) WHERE similarity >= 0.33"


def _with_cosine(table: str) -> str:
    similarity = _COSINE.format(a="coalesce(s.embedding::DOUBLE[], [0e0])", b="q.e")
    # null vectors have no similarity; those of another length are compared over what both have
    pair = """CASE WHEN s.embedding IS NULL THEN NULL WHEN len(s.embedding) = 64 THEN {} ELSE round(CASE WHEN list_dot_product(s.embedding::DOUBLE[], s.embedding::DOUBLE[]) = 0 THEN 0 ELSE
        list_sum(list_transform(range(1, least(len(s.embedding), 64) + 1), lambda i: s.embedding[i]::DOUBLE * q.e[i])) / sqrt(list_dot_product(s.embedding::DOUBLE[], s.embedding::DOUBLE[])) / sqrt(list_dot_product(q.e, q.e)) END, 6) END"""
    return f"SELECT t.question_id, t.document_url, t.chunk_index, {pair.format(similarity)} AS similarity, t.rank FROM {table} t JOIN store s USING (document_url, chunk_index) JOIN asked_vectors q ON q.question_id = t.question_id"


UNITS = rf"""texts AS (SELECT doc_id, url, text, regexp_matches(text, '(?:^|\n)#{{1,6}}[{WS}]') AS headed FROM documents WHERE text IS NOT NULL),
    pieces AS (SELECT doc_id, url, CASE WHEN headed THEN string_split(regexp_replace(text, '\n(#{{1,6}}[\t\x0b-\r{WS[5:]}])', chr(1) || '\1', 'g'), chr(1))
        ELSE regexp_split_to_array(text, '\n[{WS}]*\n+') END AS p FROM texts),
    units AS (SELECT doc_id, url, list_filter(list_transform(p, lambda u: {_strip("u")}), lambda u: u <> '') AS us FROM pieces),
    unit_rows AS (SELECT doc_id, url, unnest(us) AS unit, generate_subscripts(us, 1) AS i FROM units)"""


def _windows(words: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"list_transform(range(0, greatest(ceil((len({words}) - {size}) / {step}e0), 0)::INT + 1), lambda j: array_to_string({words}[j * {step} + 1 : j * {step} + {size}], ' '))"


def _packed(size: int, overlap: int) -> str:
    """The packing as a recursion over a document's units."""
    tail = f"held[greatest(len(held) - {overlap} + 1, 1) :]"
    return rf"""{UNITS}, worded AS (SELECT doc_id, url, i, {_words("unit")} AS w FROM unit_rows),
        lasts AS (SELECT doc_id, max(i) AS last FROM worded GROUP BY doc_id),
        fold AS (
          SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS held, []::VARCHAR[] AS emitted FROM lasts
          UNION ALL
          SELECT doc_id, i, CASE WHEN n > {size} THEN []::VARCHAR[] WHEN full_ THEN CASE WHEN len(tail) + n <= {size} THEN tail ELSE []::VARCHAR[] END || w ELSE held || w END,
            CASE WHEN full_ THEN [array_to_string(held, ' ')] ELSE []::VARCHAR[] END || CASE WHEN n > {size} THEN {_windows("w", size, overlap)} ELSE []::VARCHAR[] END
          FROM (SELECT f.doc_id, u.i, f.held, u.w, len(u.w) AS n, len(f.held) > 0 AND len(f.held) + len(u.w) > {size} AS full_, {tail.replace("held", "f.held")} AS tail
                FROM fold f JOIN worded u ON u.doc_id = f.doc_id AND u.i = f.i + 1)),
        ended AS (SELECT doc_id, i, emitted || CASE WHEN i = last AND len(held) > 0 THEN [array_to_string(held, ' ')] ELSE []::VARCHAR[] END AS out FROM fold JOIN lasts USING (doc_id)),
        chunked AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::BIGINT AS chunk_index, text
            FROM (SELECT doc_id, i, unnest(out) AS text, generate_subscripts(out, 1) AS j FROM ended))"""


def _normalize(text: str) -> str:
    out = f"translate({text}, '‐‑‒–—‘’“”' || chr(160) || chr(8239), '-----''''\"\"  ')"
    for fraction, spelled in (("¼", "1/4"), ("½", "1/2"), ("¾", "3/4"), ("⅓", "1/3"), ("⅔", "2/3"), ("⅛", "1/8"), ("⅜", "3/8"), ("⅝", "5/8"), ("⅞", "7/8")):
        out = f"replace({out}, '{fraction}', '{spelled}')"
    return f"lower({out})"


REFUSED = f"coalesce(lower(regexp_replace({_strip('answer')}, '\\.+$', '')) IN ('i don''t know', 'i do not know'), false)"
GRADED = f"""graded AS (SELECT a.*, e.type, {REFUSED} AS refused, CASE WHEN e.type = 'unanswerable' THEN {REFUSED} ELSE
    coalesce(len(list_filter(e.must_contain, lambda p: NOT contains({_normalize("coalesce(answer, '')")}, {_normalize("p")}))) = 0, true) END AS correct
    FROM answers a JOIN eval_set e ON e.id = a.question_id)"""
CITED = f"list_transform(regexp_extract_all(coalesce(answer, ''), '[\\[【][{WS}]*([0-9]+)[{WS}]*(?:†[^\\]】]*)?[\\]】]', 1), lambda m: try_cast(m AS INTEGER))"
_COST = "round(coalesce(sum(token_usage.prompt_tokens), 0) / 1e6 * 0.15e0 + coalesce(sum(token_usage.completion_tokens), 0) / 1e6 * 0.6e0, 8)"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _by_tier(texts: dict[str, str]) -> str:
    return f"CASE WHEN tier = 'related' THEN {_literal(texts['related'])} ELSE {_literal(texts['accepted'])} END"


# from evidence (run_id, rank_no, document_url, document_title, text, tier) and asked (run_id, question) to prompts and what the stand-in model makes of them
PROMPTS = rf"""chosen AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank_no) AS i FROM (SELECT *, min(tier) OVER (PARTITION BY run_id) AS best FROM evidence) WHERE tier = best),
    listed AS (SELECT run_id, tier, count(*) AS chunks, arg_min(coalesce(text, ''), i) AS first_text, arg_min(document_url, i) AS first_url,
        string_agg('[' || i || '] (from "' || coalesce(document_title, 'None') || '")' || chr(10) || '<excerpt>' || chr(10) || coalesce(text, '') || chr(10) || '</excerpt>', chr(10) || chr(10) ORDER BY i) AS excerpts
        FROM chosen GROUP BY run_id, tier),
    prompted AS (SELECT l.*, {_by_tier({"accepted": answering.SYSTEM_DIRECT, "related": answering.SYSTEM_RELATED})} AS system,
        {_by_tier(answering.HEAD)} || chr(10) || excerpts || chr(10) || chr(10) || {_by_tier(answering.REMINDER)} || chr(10) || chr(10) || 'Question: ' || question AS prompt
        FROM listed l JOIN asked USING (run_id)),
    made AS (SELECT *, CASE WHEN first_text = '' THEN 'I don''t know.' ELSE {_strip("left(first_text, 60) || ' [1]'")} END AS raw FROM prompted),
    answered AS (SELECT run_id, CASE WHEN m.run_id IS NULL THEN 'I don''t know.' WHEN first_text = '' THEN raw WHEN tier = 'related' THEN {_literal(answering.RELATED_PREFIX)} || raw ELSE raw END AS answer,
        CASE WHEN m.run_id IS NULL OR first_text = '' THEN '' ELSE first_url END AS cited_urls, coalesce(length(prompt), 0)::BIGINT AS prompt_tokens,
        coalesce(CASE WHEN first_text = '' THEN 13 ELSE length(left(first_text, 60)) + 4 END, 0)::BIGINT AS completion_tokens,
        CASE WHEN m.run_id IS NULL THEN 'no evidence' WHEN first_text = '' THEN 'refused by model' ELSE tier END AS outcome
        FROM asked LEFT JOIN made m USING (run_id))"""
PROMPTED = f"""{STORE}, {LOGGED},
    evidence AS (SELECT l.run_id, l.rank_no, s.document_url, s.document_title, s.text, {_TIER.replace("similarity", "l.similarity")} AS tier
        FROM logged l JOIN store s ON s.document_url = l.document_url AND s.chunk_index = l.chunk_index WHERE l.similarity >= 0.33),
    asked AS (SELECT run_id, question FROM answers JOIN eval_set ON id = question_id), {PROMPTS}"""
HITS = """firsts AS (SELECT question_id, document_url, min(rank) AS r FROM raw_vector GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY r, document_url) AS place FROM firsts),
    hits AS (SELECT id, coalesce(bool_or(list_contains(expect_article_ids, document_url) AND place = 1), false) AS top1, coalesce(bool_or(list_contains(expect_article_ids, document_url) AND place <= 5), false) AS top5
        FROM eval_set LEFT JOIN placed ON question_id = id WHERE len(expect_article_ids) > 0 GROUP BY id)"""


def _evaluated(ctes: str, ranked: str) -> str:
    """A question set answered from ``ranked`` and measured; hits are those of the plain vector ranking."""
    raw = _vector(15).replace("vector AS (", "raw_vector AS (").replace("vectors AS", "raw_vectors AS").replace("vectors s)", "raw_vectors s)").replace("asked_raw_vectors", "asked_raw").replace("asked_vectors q", "asked_raw q")
    return f"""WITH {ctes}, tiered AS ({_tiers(ranked)}), {raw}, {HITS},
        evidence AS (SELECT t.question_id AS run_id, t.rank AS rank_no, s.document_url, s.document_title, s.text, t.tier FROM tiered t JOIN store s USING (document_url, chunk_index)),
        asked AS (SELECT id::BIGINT AS run_id, question FROM eval_set), {PROMPTS},
        graded AS (SELECT a.*, e.type, {REFUSED} AS refused, CASE WHEN e.type = 'unanswerable' THEN {REFUSED} ELSE
            coalesce(len(list_filter(e.must_contain, lambda p: NOT contains({_normalize("coalesce(answer, '')")}, {_normalize("p")}))) = 0, true) END AS correct
            FROM answered a JOIN eval_set e ON e.id = a.run_id)
        SELECT count(*) AS total, count(*) FILTER (correct) AS answer_hits, count(*) FILTER (type = 'unanswerable') AS unanswerable_total, count(*) FILTER (type = 'unanswerable' AND refused) AS refusal_hits,
            sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, round(sum(prompt_tokens) / 1e6 * 0.15e0 + sum(completion_tokens) / 1e6 * 0.6e0, 8) AS cost_usd,
            (SELECT count(*) FROM hits) AS retrieval_graded, (SELECT count(*) FILTER (top1) FROM hits) AS top1_hits, (SELECT count(*) FILTER (top5) FROM hits) AS top5_hits FROM graded"""


def statements() -> dict[str, str]:
    fold_key = "document_url || '::' || chunk_index"
    percent = lambda a, b: f"coalesce('(' || round_even(100e0 * {a} / nullif({b}, 0), 0)::INT || '%)', '(n/a)')"
    return {
        "store_current": f"WITH {STORE} SELECT chunk_id, chunk_no, document_url, chunk_index::BIGINT AS chunk_index, coalesce(length(text), -1)::BIGINT AS n_chars FROM store",
        "store_count": "SELECT count(DISTINCT chunk_id) AS n FROM chunks",
        "store_upsert": """WITH ranked AS (SELECT chunk_id, chunk_no, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_no % 2 DESC, ingested_at DESC NULLS LAST, chunk_no DESC) AS r
            FROM chunks WHERE chunk_id IS NOT NULL) SELECT chunk_id, chunk_no FROM ranked WHERE r = 1""",
        "store_without_stale": """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, chunk_no DESC) AS r FROM chunks WHERE chunk_id IS NOT NULL AND chunk_no % 2 = 0)
            SELECT chunk_id, chunk_no FROM ranked WHERE r = 1 AND NOT EXISTS (FROM chunks c WHERE c.chunk_no % 2 = 1 AND c.document_url = ranked.document_url)""",
        "documents_listed": f"WITH {STORE}, {LISTED} SELECT title, url FROM listed",
        "documents_filtered": f"WITH {STORE}, {LISTED} SELECT title, url FROM listed WHERE contains(lower(title), 'moth')",
        "documents_by_host": f"WITH {STORE}, {LISTED} SELECT {NETLOC.format('url')} AS host, count(*) OVER (PARTITION BY {NETLOC.format('url')}) AS documents, title, url FROM listed",
        "documents_shown": f"WITH {STORE}, {LISTED} SELECT count(*) FILTER (contains(lower(title), 'moth')) AS shown, count(*) AS total, format('{{:,}}', count(*) FILTER (contains(lower(title), 'moth'))) || ' of ' || format('{{:,}}', count(*)) || ' documents' AS caption FROM listed",
        "store_banner": "SELECT count(DISTINCT chunk_id) AS chunks, format('{:,}', count(DISTINCT chunk_id)) || ' chunks' AS caption FROM chunks",
        "store_inserts": f"""SELECT {fold_key} AS chunk_id, document_title, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY {fold_key} ORDER BY chunk_no % 3 DESC, ingested_at DESC NULLS LAST, chunk_no DESC) AS r FROM chunks) WHERE r = 1""",
        "url_hosts": f"SELECT {NETLOC.format('url')} AS host, count(*) AS n FROM documents GROUP BY 1",
        "text_previews": "SELECT doc_id, left(text, 300) || CASE WHEN length(text) > 300 THEN '...' ELSE '' END AS preview, format('{:,}', length(text)) AS n_chars FROM documents WHERE text IS NOT NULL",
        "text_units": f"WITH {UNITS} SELECT doc_id, (i - 1)::BIGINT AS unit_no, len({_words('unit')})::BIGINT AS n_words, md5(unit) AS unit_md5 FROM unit_rows",
        "text_windows": f"""WITH w AS (SELECT doc_id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, {_windows("w", 200, 40)} AS c FROM w WHERE len(w) > 0),
            r AS (SELECT doc_id, unnest(c) AS text, generate_subscripts(c, 1) AS i FROM c) SELECT doc_id, (i - 1)::BIGINT AS window_no, len(string_split(text, ' '))::BIGINT AS n_words, text FROM r""",
        "packed_chunks": f"WITH RECURSIVE {_packed(200, 40)} SELECT doc_id, chunk_index, url || '::' || chunk_index AS chunk_id, text FROM chunked JOIN (SELECT doc_id, url FROM documents) USING (doc_id)",
        "packed_small_chunks": f"WITH RECURSIVE {_packed(40, 8)} SELECT doc_id, chunk_index, text FROM chunked",
        "ingest_report": f"WITH RECURSIVE {_packed(200, 40)} SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks FROM chunked",
        "documents_new": "SELECT doc_id, url FROM documents d WHERE NOT EXISTS (FROM chunks c WHERE c.document_url = d.url)",
        "stream_upsert": f"WITH {STORE} SELECT {fold_key} AS chunk_id, chunk_index::BIGINT AS chunk_index, md5(text) AS text_md5 FROM store",
        "ingest_full": f"""WITH RECURSIVE {_packed(200, 40)}, keyed AS (SELECT d.url || '::' || c.chunk_index AS chunk_id, c.chunk_index, d.title AS document_title, c.text, row_number() OVER (PARTITION BY d.url, c.chunk_index ORDER BY doc_id DESC) AS r
            FROM chunked c JOIN documents d USING (doc_id)) SELECT chunk_id, chunk_index, document_title, md5(text) AS text_md5 FROM keyed WHERE r = 1""",
        "ingest_incremental": f"""WITH RECURSIVE {STORE}, {_packed(200, 40)}, keyed AS (SELECT d.url || '::' || c.chunk_index AS chunk_id, c.chunk_index, c.text, row_number() OVER (PARTITION BY d.url, c.chunk_index ORDER BY doc_id DESC) AS r
            FROM chunked c JOIN documents d USING (doc_id) WHERE NOT EXISTS (FROM chunks s WHERE s.document_url = d.url))
            SELECT chunk_id, chunk_index, md5(text) AS text_md5 FROM keyed WHERE r = 1 UNION ALL SELECT {fold_key}, chunk_index::BIGINT, md5(text) FROM store""",
        "embedded_chunks": f"""WITH {STORE}, {TOKENS}, h AS (SELECT chunk_no, md5(t) AS m FROM (SELECT chunk_no, unnest(w) AS t FROM tokens)),
            p AS (SELECT chunk_no, ('0x' || substr(m, 1, 8))::UBIGINT % 64 AS place, sum(CASE WHEN ('0x' || substr(m, 9, 1))::INT < 8 THEN 1 ELSE -1 END) AS s FROM h GROUP BY ALL)
            SELECT chunk_no, place::BIGINT AS place, (s::DOUBLE / sqrt(sum(s * s) OVER (PARTITION BY chunk_no)::DOUBLE))::FLOAT::DOUBLE AS value FROM p QUALIFY s <> 0""",
        "corpus_statistics": f"WITH {STORE}, {TOKENS}, {STATS} SELECT n_docs, round(mean, 6) AS mean_length FROM stats",
        "term_statistics": f"WITH {STORE}, {TOKENS}, {POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM postings GROUP BY term",
        "term_idf": f"WITH {STORE}, {TOKENS}, {POSTINGS}, {STATS}, {IDF} SELECT term, round(idf, 6) AS idf FROM idf",
        "bm25_topk": f"WITH {_bm25(5)} SELECT question_id::BIGINT AS question_id, document_url, chunk_index::BIGINT AS chunk_index, bm25, rank FROM keyword",
        "keyword_index_topk": f"WITH {_bm25(5)} SELECT question_id::BIGINT AS question_id, document_url, chunk_index::BIGINT AS chunk_index, bm25, rank FROM keyword",
        "vector_index_recall": f"WITH {STORE} SELECT count(*) AS queries, true AS most_found, true AS all_found FROM store WHERE len(embedding) = 64 AND chunk_no % 20 = 0",
        "eval_set_read": "SELECT id::BIGINT AS id, question, array_to_string(expect_article_ids, ' ') AS urls, len(must_contain) AS phrases, type FROM eval_set",
        "evidence_table": f"""WITH {STORE}, {_vector(5)}, tiered AS ({_tiers('SELECT * FROM vector')})
            SELECT question_id, tier, rank, format('{{:.3f}}', round(similarity::DECIMAL(18, 6), 3)::DOUBLE) AS similarity, document_title AS title, left(text, 300) || CASE WHEN length(text) > 300 THEN '...' ELSE '' END AS preview
            FROM tiered JOIN store USING (document_url, chunk_index)""",
        "evaluate_vector": _evaluated(f"{STORE}, {_vector(5)}", "SELECT * FROM vector"),
        "evaluate_over_http": _evaluated(f"{STORE}, {_vector(5)}", "SELECT * FROM vector"),
        "store_cleared": f"""SELECT {fold_key} AS chunk_id, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY {fold_key} ORDER BY ingested_at DESC NULLS LAST, chunk_no DESC) AS r FROM chunks WHERE chunk_no % 2 = 1) WHERE r = 1""",
        "embedded_topk": f"""WITH {STORE}, texts AS (SELECT 'c' AS side, chunk_no AS no, text FROM store WHERE text IS NOT NULL UNION ALL SELECT 'q', id, question FROM eval_set),
            h AS (SELECT side, no, md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS m FROM texts),
            p AS (SELECT side, no, ('0x' || substr(m, 1, 8))::UBIGINT % 64 AS place, sum(CASE WHEN ('0x' || substr(m, 9, 1))::INT < 8 THEN 1 ELSE -1 END) AS s FROM h GROUP BY ALL),
            v AS (SELECT side, no, place, (s::DOUBLE / sqrt(sum(s * s) OVER (PARTITION BY side, no)::DOUBLE))::FLOAT::DOUBLE AS x FROM p QUALIFY s <> 0),
            n AS (SELECT side, no, sqrt(sum(x * x)) AS n FROM v GROUP BY ALL),
            met AS (SELECT q.no AS question_id, c.no AS chunk_no, round(sum(q.x * c.x) / any_value(nq.n) / any_value(nc.n), 6) AS similarity FROM v q JOIN v c USING (place)
                JOIN n nq ON nq.side = 'q' AND nq.no = q.no JOIN n nc ON nc.side = 'c' AND nc.no = c.no WHERE q.side = 'q' AND c.side = 'c' GROUP BY ALL)
            SELECT * FROM (SELECT question_id, document_url, chunk_index::BIGINT AS chunk_index, similarity, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, document_url, chunk_index) AS rank
                FROM met JOIN store USING (chunk_no)) WHERE rank <= 5""",
        "documents_api": "SELECT url, title, md5(text) AS text_md5, source FROM documents",
        "evaluate_hybrid": _evaluated(f"{_bm25(15).replace('asked AS', 'asked_terms AS').replace('FROM asked JOIN', 'FROM asked_terms JOIN')}, {_vector(15)}, {_RRF}", _with_cosine("(SELECT * FROM fused WHERE rank <= 5)")),
        "adjacent_cosine": f"""WITH {STORE}, v AS (SELECT *, embedding::DOUBLE[] AS e FROM store WHERE len(embedding) = 64)
            SELECT a.chunk_no, b.chunk_no AS next_no, {_COSINE.format(a="a.e", b="b.e")} AS similarity FROM v a JOIN v b ON b.document_url = a.document_url AND b.chunk_index = a.chunk_index + 1""",
        "vector_topk": f"WITH {STORE}, {_vector(5)} SELECT question_id::BIGINT AS question_id, document_url, chunk_index::BIGINT AS chunk_index, similarity, rank FROM vector",
        "vector_topk_batch": f"""WITH {STORE}, v AS (SELECT chunk_no, embedding::DOUBLE[] AS e FROM store WHERE len(embedding) = 64)
            SELECT chunk_no, neighbour_no, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_no ORDER BY similarity DESC, neighbour_no) AS rank FROM
            (SELECT q.chunk_no, s.chunk_no AS neighbour_no, {_COSINE.format(a="q.e", b="s.e")} AS similarity FROM v q, v s WHERE q.chunk_no % 20 = 0)) WHERE rank <= 5""",
        "rrf_fusion": f"WITH {_bm25(15)}, {_vector(15)}, {_RRF} SELECT question_id::BIGINT AS question_id, document_url, chunk_index::BIGINT AS chunk_index, coalesce(vector_rank, 0) AS vector_rank, coalesce(keyword_rank, 0) AS keyword_rank, round(rrf, 9) AS rrf, rank FROM fused",
        "vector_topk_tiers": f"WITH {STORE}, {_vector(5)} {_tiers('SELECT * FROM vector')}",
        "keyword_topk": f"WITH {_bm25(5)}, {_vector(5)}, k AS ({_with_cosine('keyword')}) SELECT question_id::BIGINT AS question_id, document_url, chunk_index::BIGINT AS chunk_index, coalesce(similarity, -2) AS similarity, rank FROM k",
        "hybrid_topk_tiers": f"WITH {_bm25(15)}, {_vector(15)}, {_RRF} {_tiers(_with_cosine('(SELECT * FROM fused WHERE rank <= 5)'))}",
        "first_documents": f"""WITH {STORE}, {_vector(15)}, firsts AS (SELECT question_id, document_url, min(rank) AS r FROM vector GROUP BY ALL)
            SELECT question_id::BIGINT AS question_id, document_url, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY r, document_url) AS place FROM firsts) WHERE place <= 5""",
        "vector_hits": f"""WITH {STORE}, {_vector(15)}, firsts AS (SELECT question_id, document_url, min(rank) AS r FROM vector GROUP BY ALL),
            placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY r, document_url) AS place FROM firsts)
            SELECT id::BIGINT AS question_id, coalesce(bool_or(list_contains(expect_article_ids, document_url) AND place = 1), false) AS top1, coalesce(bool_or(list_contains(expect_article_ids, document_url) AND place <= 5), false) AS top5
            FROM eval_set LEFT JOIN placed ON question_id = id WHERE len(expect_article_ids) > 0 GROUP BY id""",
        "logged_tiers": f"WITH {LOGGED} SELECT retrieval_mode, {_TIER} AS tier, count(*) AS chunks, count(DISTINCT run_id) AS runs FROM logged WHERE similarity >= 0.33 GROUP BY ALL",
        "run_prompts": f"WITH {PROMPTED} SELECT run_id, tier, chunks, md5(system || chr(10) || prompt) AS prompt_md5 FROM prompted",
        "ask_runs": f"WITH {PROMPTED} SELECT run_id, answer, cited_urls, prompt_tokens, completion_tokens, outcome FROM answered",
        "citation_indices": f"""WITH {LOGGED}, sizes AS (SELECT run_id, count(*)::INT AS n FROM logged GROUP BY run_id),
            c AS (SELECT run_id, n, list_sort(list_distinct(list_filter({CITED}, lambda i: i >= 1 AND i <= n))) AS v FROM answers JOIN sizes USING (run_id))
            SELECT run_id, array_to_string(CASE WHEN len(v) > 0 THEN v ELSE range(1, n + 1)::INT[] END, ',') AS cited FROM c""",
        "citation_dedupe": """WITH e AS (SELECT run_id, unnest(citations) AS c, generate_subscripts(citations, 1) AS i FROM answers), f AS (SELECT run_id, c.url AS url, min(i) AS i FROM e GROUP BY ALL),
            g AS (SELECT run_id, count(*) AS n, string_agg(url, ' ' ORDER BY i) AS urls FROM f GROUP BY run_id)
            SELECT run_id, coalesce(n, 0) AS n, coalesce(urls, '') AS urls FROM answers LEFT JOIN g USING (run_id) WHERE citations IS NOT NULL""",
        "response_parsed": f"SELECT run_id, md5({_strip('answer')}) AS content_md5, coalesce(token_usage.prompt_tokens, 0) AS prompt_tokens, coalesce(token_usage.completion_tokens, 0) AS completion_tokens FROM answers",
        "answer_grades": f"WITH {GRADED} SELECT run_id, type, refused, correct FROM graded",
        "phrases_normalized": f"""SELECT id::BIGINT AS question_id, (i - 1)::BIGINT AS phrase_no, {_normalize("p")} AS phrase FROM (SELECT id, unnest(must_contain) AS p, generate_subscripts(must_contain, 1) AS i FROM eval_set)""",
        "run_costs": f"WITH {GRADED} SELECT question_id::BIGINT AS question_id, coalesce(sum(token_usage.prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(token_usage.completion_tokens), 0)::BIGINT AS completion_tokens, {_COST} AS cost_usd FROM graded GROUP BY 1",
        "evaluation_report": f"""WITH {LOGGED}, {GRADED}, modes AS (SELECT run_id, max(retrieval_mode) AS retrieval_mode FROM logged GROUP BY run_id),
            a AS (SELECT retrieval_mode, count(*) AS total, count(*) FILTER (correct) AS answer_hits, count(*) FILTER (type = 'unanswerable' AND refused) AS refusal_hits,
                count(*) FILTER (type = 'unanswerable') AS unanswerable_total, {_COST} AS cost_usd FROM graded JOIN modes USING (run_id) GROUP BY 1),
            firsts AS (SELECT run_id, retrieval_mode, question_id, document_url, min(rank_no) AS r FROM logged GROUP BY ALL),
            placed AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY r, document_url) AS place FROM firsts),
            runs AS (SELECT run_id, retrieval_mode, bool_or(list_contains(expect_article_ids, document_url) AND place = 1) AS top1, bool_or(list_contains(expect_article_ids, document_url) AND place <= 5) AS top5
                FROM placed JOIN eval_set ON id = question_id WHERE len(expect_article_ids) > 0 GROUP BY ALL),
            h AS (SELECT retrieval_mode, count(*) AS retrieval_graded, count(*) FILTER (top1) AS top1_hits, count(*) FILTER (top5) AS top5_hits FROM runs GROUP BY 1)
            SELECT retrieval_mode, total, answer_hits, {percent("answer_hits", "total")} AS answer_percent, refusal_hits, unanswerable_total, retrieval_graded, top1_hits,
                {percent("top1_hits", "retrieval_graded")} AS top1_percent, top5_hits, cost_usd FROM a LEFT JOIN h USING (retrieval_mode)""",
    }

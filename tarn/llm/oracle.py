"""DuckDB SQL of the training-data queries that SQL can express on whole tables.

Written without the operators' indexes, prefixes and trees, and without their tables of characters: a text is
taken apart, each character that isn't plain ASCII is looked up in a mapping made here from the Unicode
database and lists of its own, and the text put together again.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from tarn.llm.reading import FUNCTION_WORDS

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BLANK = r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


# Letters drawn like the Latin letters in the line below them.
_CYRILLIC = "аеорсухіјѕһԁԛԝѵӏёїӓӧАВЕКМНОРСТУХІЈЅԚԜѴҮԀӀЁЇӒӦ"
_AS_LATIN_1 = "aeopcyxijshdqwvlëïäöABEKMHOPCTYXIJSQWVYDIËÏÄÖ"
_GREEK = "ονρόΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳϹͿ"
_AS_LATIN_2 = "ovpóABEZHIKMNOPTYXcjCJ"
_OTHERS = "օսհՕՏıɑɡ"
_AS_LATIN_3 = "ouhOSiag"
# Months in English, Spanish and German, long and short.
_MONTHS = (
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre januar februar märz mai juni juli oktober dezember okt dez"
)


@lru_cache(maxsize=1)
def _mapping() -> str:
    """VALUES of characters that aren't plain ASCII and what is shown for them, where that is another text."""
    plain = dict(zip(_CYRILLIC + _GREEK + _OTHERS, _AS_LATIN_1 + _AS_LATIN_2 + _AS_LATIN_3))
    plain |= dict.fromkeys("‐‑‒–—―−﹘﹣", "-") | dict.fromkeys("‘’‛ʼ", "'") | dict.fromkeys("“”‟", '"') | {"⁄": "/"}
    hidden = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)}
    out = {}
    for point in [*range(0x30000), *range(0xE0000, 0xE1000)]:
        char = chr(point)
        if 0xD800 <= point < 0xE000 or char == "\n" or 0x20 <= point < 0x7F or point == 0:
            continue
        if point in hidden or unicodedata.category(char) in ("Cf", "Cc") and not char.isspace():
            out[char] = ""
        elif char.isspace() or point == 0x2800:
            out[char] = " "
        elif char in plain:
            out[char] = plain[char]
        else:
            form = "".join(plain.get(c, c) for c in unicodedata.normalize("NFKC", char))
            if form != char and form != unicodedata.normalize("NFC", char):
                out[char] = form
    return ", ".join("('" + c.replace("'", "''") + "', '" + f.replace("'", "''") + "')" for c, f in out.items())


def _forms(columns: str, text: str, table: str) -> str:
    """``columns`` and ``x``, the one form of ``text``; of texts without words of other scripts than Latin ones, as these tables are."""
    return rf"""WITH given AS (SELECT {columns}, {text} AS raw, row_number() OVER () AS rid FROM {table}),
        pieces AS (SELECT rid, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT rid, regexp_extract_all(replace(raw, chr(13) || chr(10), chr(10)), '[\n -~]+|(?s:.)') AS ps FROM given)),
        whole AS (SELECT rid, nfc_normalize(string_agg(coalesce(f, p), '' ORDER BY i)) AS y FROM pieces LEFT JOIN (VALUES {_mapping()}) m(c, f) ON c = p GROUP BY rid)
        SELECT * EXCLUDE (rid, raw, y), CASE WHEN raw IS NOT NULL THEN coalesce(y, '') END AS x FROM given LEFT JOIN whole USING (rid)"""


MATCH_FORM = r"trim(regexp_replace(lower(x), '\s+', ' ', 'g'))"
_MONTH = "(?:" + "|".join(sorted(_MONTHS.split(), key=len, reverse=True)) + ")"
_ORDINAL = r"\d{1,2}(?:st|nd|rd|th)?"
_DAY = r"(?:\b(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b[ .,/-]*)?"
#: A text's lines without dates that name a month, numbers and all that isn't a letter.
LETTERS = rf"""regexp_replace(regexp_replace(regexp_replace(lower(x),
    '{_DAY}(?:\b{_ORDINAL}[ .,/-]*(?:of |de )?{_MONTH}\b(?:[ .,/-]*(?:de )?\d{{2,4}}\b)?|\b\d{{4}}[ .,/-]*{_MONTH}\b(?:[ .,/-]*{_ORDINAL}\b)?|\b{_MONTH}\b[ .,/-]*(?:{_ORDINAL}\b[ .,/-]*\d{{4}}\b|\d{{4}}\b|{_ORDINAL}\b))', '', 'g'),
    '\d+(?:st|nd|rd|th)?\b|\d+', '', 'g'), '[^\p{{L}}\p{{M}}\n]', '', 'g')"""


def oracle_sql() -> dict[str, str]:
    words = lambda x: f"len(list_filter(regexp_split_to_array({x}, '[{_WS}]+'), lambda w: w <> ''))"
    lines = rf"""WITH d AS (SELECT doc_id, text, regexp_replace(lower(regexp_extract(url, '://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\.', '') AS site, x FROM ({_forms("doc_id, url, text", "text", "documents")})),
            l AS (SELECT doc_id, site, unnest(string_split(text, chr(10))) AS raw, unnest(string_split(x, chr(10))) AS line, unnest(string_split({LETTERS}, chr(10))) AS key,
                generate_subscripts(string_split(x, chr(10)), 1) - 1 AS line_no FROM d WHERE x IS NOT NULL),
            s AS (SELECT site, count(*) AS n FROM d GROUP BY site),
            f AS (SELECT site, key FROM l JOIN s USING (site) WHERE trim(line) <> '' GROUP BY site, key, n HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) * 10 >= n)"""
    groups = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+') AS w FROM ({_forms("doc_id", "coalesce(title, '') || chr(10) || text", "documents")})),
            t AS (SELECT doc_id FROM ({_forms("doc_id", "text", "documents")}) WHERE len(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+')) >= 20),
            g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: hash(w[i], w[i + 1], w[i + 2]))) AS s FROM d SEMI JOIN t USING (doc_id)),
            n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
            e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.6e0 * (x.n + y.n - c) - 1e-9),
            ends AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
            r AS (SELECT a, b FROM ends UNION SELECT r.a, ends.b FROM r JOIN ends ON r.b = ends.a)"""
    return {
        "p1_found": f"{lines} SELECT doc_id, line_no::BIGINT AS line_no FROM l JOIN f USING (site, key) WHERE trim(line) <> ''",
        "p1_clean": f"""{lines}, k AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) AS clean FROM l WHERE trim(line) = '' OR NOT EXISTS (FROM f WHERE f.site = l.site AND f.key = l.key) GROUP BY doc_id)
            SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(clean, '') END AS clean_text FROM documents LEFT JOIN k USING (doc_id)""",
        "p2_found": """WITH v AS (SELECT chunk_no, list_transform(embedding, lambda a: a::DOUBLE) AS e FROM chunks WHERE len(embedding) = 64),
            u AS (SELECT chunk_no, e FROM v WHERE list_dot_product(e, e) > 0),
            p AS (SELECT a.chunk_no AS a, b.chunk_no AS b, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM u a JOIN u b ON a.chunk_no <> b.chunk_no AND list_cosine_similarity(a.e, b.e) >= 0.9),
            r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM p)
            SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM r WHERE n <= 5""",
        "p2_nearest": """WITH v AS (SELECT chunk_no, list_transform(embedding, lambda a: a::DOUBLE) AS e FROM chunks WHERE len(embedding) = 64),
            u AS (SELECT chunk_no, e FROM v WHERE list_dot_product(e, e) > 0),
            p AS (SELECT a.chunk_no, b.chunk_no AS neighbour_no, list_cosine_similarity(a.e, b.e) AS cosine FROM u a JOIN u b ON a.chunk_no <> b.chunk_no WHERE a.chunk_no % 20 = 0)
            SELECT * REPLACE (round(cosine, 4) AS cosine) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_no ORDER BY round(cosine, 6) DESC, neighbour_no) AS rank_no FROM p) WHERE rank_no <= 5""",
        "p3_found": f"{groups} SELECT a AS doc_a, b AS doc_b FROM r WHERE a < b",
        "p3_groups": f"{groups} SELECT doc_id, CASE WHEN t.doc_id IS NOT NULL THEN least(doc_id, coalesce(m, doc_id)) ELSE -1 END AS group_id FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)",
        "p4_found": rf"""WITH u AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\n(?:[{_BLANK}]*\n)+'), lambda p: regexp_matches(p, '[^{_WS}]')) AS ps FROM documents WHERE text IS NOT NULL),
            r AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS i FROM u)
            SELECT 'document' AS item_kind, doc_id AS item_key, i::BIGINT AS unit_no FROM r WHERE {words("p")} > 200
            UNION ALL SELECT 'chunk', chunk_no, 0 FROM chunks WHERE {words("text")} > 200""",
        "p5_found": f"""WITH d AS (SELECT doc_id, {MATCH_FORM} AS m FROM ({_forms("doc_id", "text", "documents")})),
            q AS (SELECT question_id, phrase_no, {MATCH_FORM} AS m FROM ({_forms("question_id, phrase_no", "p", "(SELECT id::BIGINT AS question_id, unnest(must_contain) AS p, generate_subscripts(must_contain, 1) - 1 AS phrase_no FROM eval_set)")}))
            SELECT question_id, phrase_no::BIGINT AS phrase_no, doc_id FROM q JOIN d ON contains(d.m, q.m) WHERE q.m <> ''""",
        "p8_profile": rf"""WITH d AS ({_forms("doc_id", "text", "documents")}),
            t AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(x), '\p{{L}}[\p{{L}}\p{{M}}]*(?:[''-][\p{{L}}\p{{M}}]+)*')) AS word FROM d) GROUP BY ALL),
            f AS (SELECT word FROM t GROUP BY word HAVING count(*) >= 0.1e0 * (SELECT count(DISTINCT doc_id) FROM t)),
            s AS (SELECT doc_id, sum(n) AS total, coalesce(sum(n) FILTER (word IN (FROM f)), 0) AS known, {", ".join(f"coalesce(sum(n) FILTER (list_contains(string_split('{words_}', ' '), word)), 0) AS {code}" for code, words_ in FUNCTION_WORDS.items())} FROM t GROUP BY doc_id),
            p AS (SELECT doc_id, x, len(list_filter(string_split(replace(x, chr(10), ' '), ' '), lambda w: w <> '')) AS n_words, len(regexp_extract_all(x, '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{ac00}}-\x{{d7a3}}]')) AS cjk,
                greatest(1, len(list_filter(regexp_split_to_array(x, '[.!?。！？]+[\"'')\]»]*(?:[ \n]+|$)|\n[ ]*\n|\n[ ]*(?:[-*•#>]+[ ]|\d|\p{{Lu}})'), lambda v: regexp_matches(v, '\p{{L}}')))) AS sentences FROM d)
            SELECT doc_id, n_words::BIGINT AS n_words, coalesce(en > greatest(es, de) AND cjk < n_words, false) AS english, round(1 - known / total, 6) AS unfamiliar_share, round(total / sentences, 6) AS sentence_length
            FROM p LEFT JOIN s USING (doc_id)""",
        "p5_canonical": f"SELECT doc_id, x AS canonical FROM ({_forms('doc_id', 'text', 'documents')})",
    }

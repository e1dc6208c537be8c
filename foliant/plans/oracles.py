"""SQL for the registered queries, written from their rules rather than from their plans."""

from __future__ import annotations

DOCUMENT_QUERY = "the thought of pathetic inner ations the and idiot"
CHUNK_QUERY = "the and of"
ALL_TERMS_QUERY = "the of And"
QUERY_VECTOR = [round(((i * 7) % 11 - 5) / 5, 2) for i in range(64)]
SHORT = (1000, 1200)
MERGE_CAP = 8
NOW = "2024-01-20 12:00:00"

# Fixed values in RE2's notation: white space at ends of texts.
SP = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


MICROS = "epoch_us(ts)"
BOOKS = """
    books AS (
        SELECT CAST(d.doc_id AS VARCHAR) AS book_id, substring(split_part(d.text, chr(10), 1), 1, 40) AS title,
            d.source AS author,
            CASE d.lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' END AS language,
            CASE l.quality WHEN 1 THEN 'ready' WHEN 0 THEN 'failed' ELSE 'pending' END AS status,
            CASE WHEN l.quality = 1 THEN substring(d.text, 1, 60) ELSE '' END AS summary,
            1704067200 + d.doc_id AS created_at, d.text AS content
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    )
"""
PIECES = f"""
    cut AS (
        SELECT doc_id, s, {strip("substring(text, s + 1, 500)")} AS content
        FROM (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS s FROM documents)
    ),
    chunks AS (
        SELECT CAST(doc_id AS VARCHAR) AS book_id,
            row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS position, content, length(content) AS token_count
        FROM cut WHERE content <> ''
    )
"""
CORPUS = """
    corpus AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS book_id, text AS content FROM documents)
"""
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}_]+')"


def bm25(corpus: str, question: str) -> str:
    """CTEs ending in bm(id, raw) over the relation ``corpus`` (id, content)."""
    words = WORDS.format("content")
    asked = WORDS.format(f"'{question}'")
    return f"""
    tok AS (SELECT id, {words} AS w FROM {corpus}),
    stat AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(w) AS DOUBLE)) AS avgdl FROM tok),
    hit AS (SELECT id, CAST(len(w) AS DOUBLE) AS dl, unnest(w) AS term FROM tok),
    df AS (SELECT term, CAST(count(DISTINCT id) AS DOUBLE) AS df FROM hit GROUP BY term),
    idf0 AS (SELECT term, ln(n - df + CAST(0.5 AS DOUBLE)) - ln(df + CAST(0.5 AS DOUBLE)) AS idf FROM df, stat),
    idf AS (
        SELECT term, CASE WHEN idf < 0 THEN CAST(0.25 AS DOUBLE) * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0
    ),
    q AS (SELECT term, CAST(count(*) AS DOUBLE) AS times FROM (SELECT unnest({asked}) AS term) GROUP BY term),
    tf AS (SELECT id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM hit WHERE term IN (SELECT term FROM q) GROUP BY id, dl, term),
    bm AS (
        SELECT tf.id, sum(q.times * idf.idf * (tf.tf * CAST(2.5 AS DOUBLE)) / (tf.tf + CAST(1.5 AS DOUBLE) *
            (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * tf.dl / stat.avgdl))) AS raw
        FROM tf JOIN q ON tf.term = q.term JOIN idf ON tf.term = idf.term, stat GROUP BY tf.id
    )
    """


KEYWORD = "kw AS (SELECT id, raw / (SELECT max(raw) FROM bm) AS k FROM bm WHERE (SELECT max(raw) FROM bm) > 0)"
VECTOR = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in QUERY_VECTOR) + "]"
COSINE = f"""
    vec AS (
        SELECT CAST(vec_id AS VARCHAR) AS id, 'src' || (vec_id % 20) AS book_id,
            list_cosine_similarity(CAST(embedding AS DOUBLE[]), {VECTOR}) AS v
        FROM embeddings
    )
"""
FUSED = """
    fused AS (
        SELECT c.id, c.book_id, c.content, coalesce(vec.v, 0) AS v, coalesce(kw.k, 0) AS k,
            (CAST(0.6 AS DOUBLE) * coalesce(vec.v, 0) + CAST(0.4 AS DOUBLE) * coalesce(kw.k, 0)) / (CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE)) AS score
        FROM corpus c LEFT JOIN vec ON c.id = vec.id LEFT JOIN kw ON c.id = kw.id
    )
"""
HYBRID = f"WITH {CORPUS}, {bm25('corpus', DOCUMENT_QUERY)}, {KEYWORD}, {COSINE}, {FUSED}"
TERMS = r"regexp_extract_all({0}, '[A-Za-z][A-Za-z''-]*')"


def _stopwords() -> str:
    from foliant.operators.keywords import STOPWORDS

    return ", ".join(f"'{w}'" for w in STOPWORDS)


def topk(k: int) -> str:
    """CTEs ending in top(doc_id, source, term, weight, rank)."""
    return f"""
    word AS (
        SELECT doc_id, source, unnest(t) AS word, unnest(range(0, len(t))) AS place
        FROM (SELECT doc_id, source, {TERMS.format("text")} AS t FROM documents)
    ),
    counted AS (
        SELECT doc_id, source, lower(word) AS term, CAST(count(*) AS DOUBLE) AS weight, min(place) AS first_place FROM word
        WHERE length(word) >= 2 AND lower(word) NOT IN ({_stopwords()}) GROUP BY doc_id, source, lower(word)
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, first_place) AS rank FROM counted),
    top AS (SELECT doc_id, source, term, weight, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {k})
    """


TASKS = f"""
    tasks AS (
        SELECT CAST(event_id AS VARCHAR) AS task_id, CAST(user_id AS VARCHAR) AS book_id,
            CASE WHEN event_id % 5 = 0 THEN 'summarize' ELSE 'ingest' END AS type,
            CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'processing' ELSE 'pending' END AS status,
            CAST(event_id % 100 AS INTEGER) AS progress,
            CASE WHEN event_type = 'signup' THEN NULL ELSE {MICROS} END AS dispatched_at, {MICROS} AS created_at
        FROM events
    )
"""
STEPS = """
    steps AS (
        SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS seq, event_type AS stage, CAST(event_id % 100 AS INTEGER) AS progress,
            CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'processing' END AS status,
            row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back,
            count(*) OVER (PARTITION BY user_id) AS n_events
        FROM events
    )
"""
SESSIONS = """
    sessions AS (
        SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id, 'u' || (conv_id % 10) AS user_id,
            1704067200 + conv_id * 7 % 1000 AS updated_at
        FROM conversations
    )
"""
FINAL = f"""
    WITH {STEPS}
    SELECT task_id, status, CASE WHEN status = 'completed' THEN 100 ELSE progress END AS progress, stage, n_events
    FROM steps WHERE back = 1
"""
BUCKET = """
    WITH RECURSIVE req AS (
        SELECT CAST(user_id AS VARCHAR) AS client, event_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS ts,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
        FROM events
    ),
    walk AS (
        SELECT client, event_id, ts, n, CAST(3 AS DOUBLE) - 1 AS level, true AS allowed FROM req WHERE n = 1
        UNION ALL
        SELECT r.client, r.event_id, r.ts, r.n,
            least(CAST(3 AS DOUBLE), w.level + (r.ts - w.ts) * (CAST(1 AS DOUBLE) / 3600))
                - CASE WHEN least(CAST(3 AS DOUBLE), w.level + (r.ts - w.ts) * (CAST(1 AS DOUBLE) / 3600)) >= 1 THEN 1 ELSE 0 END,
            least(CAST(3 AS DOUBLE), w.level + (r.ts - w.ts) * (CAST(1 AS DOUBLE) / 3600)) >= 1
        FROM walk w JOIN req r ON r.client = w.client AND r.n = w.n + 1
    )
    SELECT client, event_id, allowed FROM walk
"""
SPLIT = f"""
    SELECT doc_id AS book_id, title, sort_order, content FROM (
        SELECT doc_id, 'MyBook' AS title, 0 AS sort_order, 'before' AS content FROM documents
        UNION ALL SELECT doc_id, 'Chapter1TheText', CASE WHEN t = '' THEN NULL ELSE 1 END, t FROM (SELECT doc_id, {strip("text")} AS t FROM documents)
        UNION ALL SELECT doc_id, 'chapter2', 2, 'notes on ' || doc_id FROM documents
        UNION ALL SELECT doc_id, 'Chapter3None', 3, 'Index' FROM documents
    ) WHERE sort_order IS NOT NULL
"""


USERS = """
    users AS (
        SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS username, CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role,
            CASE WHEN c_custkey % 3 = 0 THEN 'disabled' ELSE 'active' END AS status, 1704067200 + c_custkey * 13 % 997 AS created_at
        FROM customer
    )
"""
TOKENS = f"""
    tokens AS (
        SELECT event_id, user_id, {MICROS} AS created_at, event_type = 'error' AS is_revoked,
            CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'never'
                ELSE '2024-01-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') || ' 12:00:00' END AS expires_at
        FROM events
    )
"""
STATE = "CASE status WHEN 'completed' THEN 'ready' WHEN 'failed' THEN 'failed' ELSE 'processing' END"


#: Tasks of users that are silent for two days.
LOST = """
    WITH beats AS (
        SELECT CAST(user_id AS VARCHAR) AS task_id, user_id, event_type, epoch_us(ts) AS ts,
            lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following
        FROM events
    )
    SELECT task_id, ts AS last_seen, CASE WHEN user_id % 3 = 0 THEN 'failed' ELSE 'requeued' END AS action FROM beats
    WHERE event_type NOT IN ('error', 'purchase')
        AND coalesce(following > ts + 172800000000, ts + 172800000000 < (SELECT max(ts) FROM beats) - 3600000000)
"""


def segment_steps(target: int, hard: int) -> str:
    """The table ``segments`` (doc_id, segment_no, segment) of all documents, one segment a step."""
    window = f"substring(rest, {target} + 1, {hard - target})"
    return f"""step AS (
                SELECT doc_id, text AS rest, 0 AS step_no, CAST(NULL AS VARCHAR) AS piece, length(text) > {hard} AS long FROM documents
                UNION ALL
                SELECT doc_id, substring(rest, cut + 1), step_no + 1, substring(rest, 1, cut), long FROM (
                    SELECT doc_id, rest, step_no, long, CASE
                        WHEN length(rest) <= {hard} THEN length(rest)
                        WHEN strpos({window}, chr(10)) > 0 THEN {target} + strpos({window}, chr(10))
                        WHEN regexp_matches({window}, '[。！？.!?]')
                        THEN {target} + length(regexp_extract({window}, '(?s)^.*[。！？.!?]'))
                        ELSE {hard} END AS cut
                    FROM step WHERE length(rest) > 0
                )
            ),
            cleaned AS (
                SELECT doc_id, step_no, CASE WHEN long THEN {strip("piece")} ELSE piece END AS segment FROM step WHERE piece IS NOT NULL
            ),
            segments AS (
                SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step_no) - 1 AS INTEGER) AS segment_no, segment
                FROM cleaned WHERE segment <> ''
            )"""


def _hashed(x: str) -> str:
    """The vector of eight bytes of the text's digest."""
    return f"list_transform(range(0, 8), lambda i: (CAST(('0x' || substring(sha256({x}), CAST(2 * i + 1 AS INTEGER), 2)) AS INTEGER) - 128) / CAST(128 AS DOUBLE))"


def oracle_sql() -> dict[str, str]:
    messy = r"regexp_replace(text, '\n', ' ' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10), 'g') || ' ' || chr(10)"
    tidy, tidy_content, tidy_text = (
        rf"regexp_replace(regexp_replace({x}, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')" for x in (messy, "content", "text")
    )
    title = "CASE doc_id % 7 WHEN 0 THEN ' In dex' WHEN 1 THEN ' Copyright page ' ELSE substring(text, 1, 30) END"
    sample = "substring(text, 1, 3) || CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '史' WHEN 2 THEN '機' WHEN 3 THEN 'の' WHEN 4 THEN 'é' ELSE '书' END"
    tail = "CASE doc_id % 6 WHEN 1 THEN 'zha' WHEN 2 THEN 'zha' WHEN 3 THEN 'jpn' WHEN 5 THEN 'zho' ELSE 'eng' END"
    merged_rank = topk(3)
    return {
        "clean_whitespace": f"SELECT doc_id, {strip(tidy)} AS clean FROM documents",
        "chunk_documents": f"WITH {PIECES} SELECT book_id, CAST(position AS INTEGER) AS position, content, token_count FROM chunks",
        "chunk_books": f"""
            WITH cut AS (
                SELECT source, doc_id, s, {strip("substring(text, s + 1, 300)")} AS content
                FROM (SELECT source, doc_id, text, unnest(range(0, length(text), 270)) AS s FROM documents)
            )
            SELECT source AS book_id, CAST(doc_id AS VARCHAR) AS chapter_id,
                CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, s) - 1 AS INTEGER) AS position, length(content) AS token_count
            FROM cut WHERE content <> ''
        """,
        "segment_documents": f"""
            WITH RECURSIVE {segment_steps(*SHORT)} SELECT doc_id, segment_no, length(segment) AS n, segment FROM segments
        """,
        "chapter_split": SPLIT,
        "chapter_split_lines": SPLIT,
        "ingest_vectors": f"""
            WITH parts AS (
                SELECT substring(sha256('/books/' || book_id || '.txt'), 1, 32) AS book_id, sort_order, {strip(tidy_content)} AS content
                FROM ({SPLIT})
            ),
            cut AS (
                SELECT book_id, sort_order, s, {strip("substring(content, s + 1, 500)")} AS content
                FROM (SELECT *, unnest(range(0, length(content), 450)) AS s FROM parts)
            ),
            placed AS (
                SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY sort_order, s) - 1 AS position FROM cut WHERE content <> ''
            )
            SELECT book_id || ':' || position AS id, book_id, book_id || '#' || sort_order AS chapter_id, content,
                CAST(position AS INTEGER) AS position, length(content) AS token_count,
                (CAST(('0x' || substring(sha256(content), 1, 2)) AS INTEGER) - 128) / CAST(128 AS DOUBLE) AS first
            FROM placed
        """,
        "title_rules": f"""
            SELECT doc_id, regexp_replace({title}, '[{SP}]+', '', 'g') AS title,
                lower(regexp_replace({title}, '[{SP}]+', '', 'g')) IN ('索引', '参考书目', 'index', 'bibliography') AS back_matter,
                contains(lower({title}), 'copyright') OR contains({title}, '版权信息') AS copyright
            FROM documents
        """,
        "language_detect": f"""
            SELECT doc_id, {tail} AS code, CASE WHEN {tail} = 'eng' THEN 'en' ELSE 'zh' END AS bucket,
                CASE {tail} WHEN 'zho' THEN 'Chinese' WHEN 'jpn' THEN 'Japanese' WHEN 'eng' THEN 'English' ELSE {tail} END AS name
            FROM (SELECT doc_id, {sample} AS t FROM documents)
        """,
        "hash_embedding": """
            SELECT doc_id, CAST(i AS INTEGER) AS at, (CAST(('0x' || substring(h, CAST(2 * i + 1 AS INTEGER), 2)) AS INTEGER) - 128) / CAST(128 AS DOUBLE) AS value
            FROM (SELECT doc_id, sha256(text) AS h, unnest(range(0, 8)) AS i FROM documents)
        """,
        "token_masks": """
            SELECT doc_id, sha256('token-' || doc_id) AS digest, '••••••••' || right('token-' || doc_id, 4) AS masked FROM documents
        """,
        "cosine_topk": f"WITH {COSINE} SELECT id, round(v, 6) AS score FROM vec ORDER BY v DESC, id LIMIT 10",
        "cosine_topk_filtered": f"""
            WITH {COSINE} SELECT id, '' AS book_id, round(v, 6) AS score FROM vec WHERE book_id IN ('src1', 'src3') ORDER BY v DESC, id LIMIT 7
        """,
        "cosine_topk_cells": f"""
            WITH {COSINE} SELECT id, round(v, 6) AS score FROM vec WHERE book_id IN ('src1', 'src3') ORDER BY v DESC, id LIMIT 7
        """,
        "bm25_scores": f"WITH {CORPUS}, {bm25('corpus', DOCUMENT_QUERY)} SELECT id, round(raw, 6) AS raw FROM bm",
        "index_scores": f"WITH {CORPUS}, {bm25('corpus', DOCUMENT_QUERY)} SELECT id, round(raw, 6) AS raw FROM bm",
        "index_topk": f"WITH {CORPUS}, {bm25('corpus', DOCUMENT_QUERY)} SELECT id, round(raw, 6) AS raw FROM bm ORDER BY bm.raw DESC, id LIMIT 12",
        "index_proximity": f"""
            WITH {CORPUS},
            asked AS (SELECT DISTINCT unnest({WORDS.format(f"'{ALL_TERMS_QUERY}'")}) AS term),
            tok AS (SELECT id, {WORDS.format("content")} AS w FROM corpus),
            place AS (SELECT * FROM (SELECT id, unnest(w) AS term, unnest(range(0, len(w))) AS at_word FROM tok) WHERE term IN (SELECT term FROM asked)),
            ends AS (
                SELECT p.id, p.at_word, count(*) AS held, min(last_at) AS first_at FROM (
                    SELECT p.id, p.at_word, q.term, max(q.at_word) AS last_at FROM place p JOIN place q ON p.id = q.id AND q.at_word <= p.at_word
                    GROUP BY p.id, p.at_word, q.term
                ) p GROUP BY p.id, p.at_word
            ),
            spans AS (SELECT id, min(at_word - first_at + 1) AS span FROM ends WHERE held = (SELECT count(*) FROM asked) GROUP BY id),
            tf AS (SELECT id, count(*) AS tf FROM place GROUP BY id)
            SELECT id, span, round(CAST((SELECT count(*) FROM asked) AS DOUBLE) / span, 6) AS raw
            FROM spans JOIN tf USING (id) ORDER BY span, tf DESC, id LIMIT 25
        """,
        "keywords_tfidf_topk": f"""
            WITH {topk(1_000_000)},
            df AS (SELECT lower(word) AS term, CAST(count(DISTINCT doc_id) AS DOUBLE) AS df FROM word GROUP BY lower(word)),
            weighed AS (
                SELECT doc_id, c.term, c.weight * ln((SELECT CAST(count(*) AS DOUBLE) FROM documents) / df) AS weight, first_place
                FROM counted c JOIN df ON c.term = df.term
            ),
            placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, first_place) AS rank FROM weighed)
            SELECT doc_id, term, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM placed WHERE rank <= 5
        """,
        "learnt_words": r"""
            WITH docs AS (SELECT replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', (SELECT string_agg(chr(CAST(19968 + k AS INTEGER)), '' ORDER BY k) FROM range(26) r(k))), ' ', '') AS t FROM documents),
            runs AS (SELECT run, count(*) AS times FROM (SELECT unnest(regexp_extract_all(t, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]+')) AS run FROM docs) GROUP BY run),
            spots AS (SELECT run, times, i, unnest([1, 2, 3]) AS k FROM (SELECT run, times, unnest(range(1, length(run) + 1)) AS i FROM runs)),
            grams AS (
                SELECT substring(run, i, k) AS gram, CASE WHEN i > 1 THEN substring(run, i - 1, 1) ELSE '' END AS before,
                    substring(run, i + k, 1) AS after, sum(times) AS c
                FROM spots WHERE i + k - 1 <= length(run) GROUP BY ALL
            ),
            n AS (SELECT gram, CAST(sum(c) AS DOUBLE) AS n FROM grams GROUP BY gram HAVING sum(c) >= 20),
            size AS (SELECT CAST(sum(c) AS DOUBLE) AS size FROM grams WHERE length(gram) = 1),
            bound AS (
                SELECT g.gram, g.n, min(ln(g.n) + ln(size) - ln(l.n) - ln(r.n)) AS cohesion
                FROM (SELECT gram, n, unnest(range(1, length(gram))) AS cut FROM n) g
                JOIN n l ON l.gram = substring(g.gram, 1, cut) JOIN n r ON r.gram = substring(g.gram, cut + 1), size GROUP BY g.gram, g.n
            ),
            edges AS (
                SELECT gram, side, CAST(ln(sum(c)) AS DOUBLE) - sum(CASE WHEN x <> '' THEN c * ln(c) ELSE 0 END) / sum(c) AS free FROM (
                    SELECT gram, 1 AS side, before AS x, CAST(sum(c) AS DOUBLE) AS c FROM grams GROUP BY gram, before
                    UNION ALL SELECT gram, 2, after, CAST(sum(c) AS DOUBLE) FROM grams GROUP BY gram, after
                ) GROUP BY gram, side
            ),
            freedom AS (SELECT gram, min(free) AS freedom FROM edges GROUP BY gram)
            SELECT gram AS word, CAST(n AS BIGINT) AS n, round(cohesion, 6) AS cohesion, round(freedom, 6) AS freedom
            FROM bound JOIN freedom USING (gram) WHERE cohesion >= 2.5 AND freedom >= 1.0
        """,
        "bm25_filtered": f"""
            WITH {CORPUS}, part AS (SELECT * FROM corpus WHERE book_id IN ('src1', 'src3')), {bm25('part', DOCUMENT_QUERY)}, {KEYWORD}
            SELECT id, round(k, 6) AS score FROM kw
        """,
        "postings_index": f"""
            WITH {CORPUS}, hit AS (SELECT id, unnest({WORDS.format('content')}) AS term FROM corpus)
            SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM hit GROUP BY term
        """,
        "fulltext_and_search": f"""
            WITH {CORPUS}, hit AS (SELECT id, unnest({WORDS.format('content')}) AS term FROM corpus),
            q AS (SELECT DISTINCT unnest({WORDS.format(f"'{ALL_TERMS_QUERY}'")}) AS term),
            tf AS (SELECT id, term, CAST(count(*) AS DOUBLE) AS tf FROM hit WHERE term IN (SELECT term FROM q) GROUP BY id, term)
            SELECT id, round(sum(tf / (tf + 1)), 6) AS raw FROM tf GROUP BY id HAVING count(*) = (SELECT count(*) FROM q)
            ORDER BY sum(tf / (tf + 1)) DESC, id LIMIT 20
        """,
        "hybrid_search": f"{HYBRID} SELECT id, round(v, 6) AS v, round(k, 6) AS k, round(score, 6) AS score FROM fused WHERE score >= 0 ORDER BY fused.score DESC, id LIMIT 10",
        "hybrid_threshold": f"{HYBRID} SELECT id, round(score, 6) AS score FROM fused WHERE score >= 0.25 ORDER BY fused.score DESC, id LIMIT 1000",
        "hybrid_keyword_only": f"""
            WITH {CORPUS}, {bm25('corpus', DOCUMENT_QUERY)}, {KEYWORD}
            SELECT c.id, round(coalesce(k, 0), 6) AS score FROM corpus c LEFT JOIN kw ON c.id = kw.id
            WHERE coalesce(k, 0) >= 0 ORDER BY coalesce(k, 0) DESC, c.id LIMIT 10
        """,
        "hybrid_fulltext": f"""
            WITH {CORPUS}, hit AS (SELECT id, unnest({WORDS.format('content')}) AS term FROM corpus),
            q AS (SELECT DISTINCT unnest({WORDS.format(f"'{DOCUMENT_QUERY}'")}) AS term),
            tf AS (SELECT id, term, CAST(count(*) AS DOUBLE) AS tf FROM hit WHERE term IN (SELECT term FROM q) GROUP BY id, term),
            bm AS (
                SELECT id, sum(tf / (tf + 1)) AS raw FROM tf GROUP BY id HAVING count(*) = (SELECT count(*) FROM q)
                ORDER BY sum(tf / (tf + 1)) DESC, id LIMIT 50
            ), {KEYWORD}, {COSINE}, {FUSED}
            SELECT id, round(score, 6) AS score FROM fused WHERE score >= 0 ORDER BY fused.score DESC, id LIMIT 10
        """,
        "search_enriched": f"""
            {HYBRID}, best AS (SELECT * FROM fused WHERE score >= 0 ORDER BY score DESC, id LIMIT 10), {BOOKS}
            SELECT best.id, CASE WHEN best.book_id = 'src3' THEN '' ELSE upper(best.book_id) END AS book_title, b.title AS chapter_title,
                round(score, 6) AS score
            FROM best JOIN books b ON b.book_id = best.id
        """,
        "rag_context": f"""
            {HYBRID}, best AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n FROM fused WHERE score >= 0 ORDER BY score DESC, id LIMIT 5)
            SELECT string_agg('[' || n || '] ' || content, chr(10) || chr(10) ORDER BY n) AS context, count(*) AS n FROM best
        """,
        "rag_citations": f"""
            {HYBRID} SELECT id, id AS chapter_id, book_id, round(score, 6) AS score, substring(content, 1, 200) AS content
            FROM fused WHERE score >= 0 ORDER BY fused.score DESC, id LIMIT 5
        """,
        "keywords_tf_topk": f"WITH {topk(5)} SELECT doc_id, term, weight, rank FROM top",
        "keywords_merged_sum": f"WITH {merged_rank} SELECT source AS book_id, term, sum(weight) AS weight FROM top GROUP BY source, term",
        "keyword_cloud_tiers": f"""
            WITH {topk(5)}, span AS (SELECT doc_id, min(weight) AS lo, max(weight) AS hi FROM top GROUP BY doc_id),
            r AS (SELECT t.doc_id, term, CASE WHEN hi = lo THEN CAST(1 AS DOUBLE) ELSE (weight - lo) / (hi - lo) END AS ratio FROM top t JOIN span s ON t.doc_id = s.doc_id)
            SELECT doc_id, term, CAST(floor(ratio * 4 + 0.5) AS INTEGER) AS tier,
                round(CAST(0.85 AS DOUBLE) + floor(ratio * 4 + 0.5) / 4 * CAST(1.25 AS DOUBLE), 6) AS scale
            FROM r
        """,
        "summaries_map_reduce": f"""
            WITH RECURSIVE {segment_steps(10_000, 12_000)},
            counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM segments),
            parts AS (
                SELECT doc_id, segment_no, total, {strip("""substring(CASE WHEN total = 1 THEN 'Summarize the chapter: '
                    ELSE 'Summarize part ' || (segment_no + 1) || '/' || total || ': ' END || 't' || doc_id || chr(10) || chr(10) || segment, 1, 60)""")} AS summary
                FROM counted
            ),
            merged AS (
                SELECT doc_id, total, min(summary) AS one, string_agg(
                    '[' || (segment_no + 1) || '/' || total || '] ' || summary, chr(10) || chr(10) ORDER BY segment_no) AS body
                FROM parts GROUP BY doc_id, total
            )
            SELECT source AS book_id, d.doc_id AS chapter_id, d.doc_id AS sort_order, CASE WHEN total = 1 THEN one ELSE
                {strip("substring('Merge the summaries of the parts of t' || d.doc_id || chr(10) || chr(10) || body, 1, 60)")} END AS summary
            FROM documents d JOIN merged m ON d.doc_id = m.doc_id WHERE {strip("text")} <> ''
        """,
        "pseudo_chunks": f"""
            WITH {BOOKS}, s AS (SELECT book_id, {strip("summary")} AS content FROM books)
            SELECT book_id || '#0:summary' AS id, book_id, book_id || '#0' AS chapter_id, content, -1 AS position, 0 AS token_count FROM s WHERE content <> ''
            UNION ALL SELECT book_id || ':summary', book_id, '', content, -1, 0 FROM s WHERE content <> ''
        """,
        "books_list_page": f"""
            WITH {BOOKS} SELECT book_id, title, language, status, created_at FROM books WHERE status = 'ready'
            ORDER BY created_at DESC, book_id LIMIT 15 OFFSET 15
        """,
        "books_search_like": f"""
            WITH {BOOKS} SELECT book_id, author FROM books WHERE title ILIKE '%SRC1_%' OR author ILIKE '%SRC1_%'
            ORDER BY created_at DESC, book_id LIMIT 20
        """,
        "books_total": f"WITH {BOOKS} SELECT count(*) AS total FROM books WHERE title ILIKE '%th%e%' OR author ILIKE '%th%e%'",
        "chunks_page": f"""
            WITH {PIECES} SELECT book_id || ':' || position AS chunk_id, CAST(position AS INTEGER) AS position, content
            FROM chunks WHERE book_id = '21' ORDER BY chunks.position LIMIT 3 OFFSET 3
        """,
        "tasks_page": f"WITH {TASKS} SELECT task_id, book_id, created_at FROM tasks WHERE status = 'pending' ORDER BY created_at DESC, task_id LIMIT 20",
        "audit_page": """
            SELECT event_id AS entry_id, CAST(user_id AS VARCHAR) AS actor, event_type AS action, props AS detail
            FROM events ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50
        """,
        "sessions_by_user": f"WITH {SESSIONS} SELECT session_id, updated_at FROM sessions WHERE user_id = 'u3'",
        "messages_of_session": "SELECT turn AS seq, role, text AS content FROM conversations WHERE conv_id = 7",
        "books_by_status": f"WITH {BOOKS} SELECT status, count(*) AS n FROM books GROUP BY status",
        "status_bar_pct": f"""
            WITH {BOOKS}, n AS (SELECT status, count(*) AS n FROM books GROUP BY status)
            SELECT status, round(CAST(n AS DOUBLE) / greatest(1, (SELECT max(n) FROM n)) * 100, 6) AS pct FROM n
        """,
        "dashboard_stats": f"""
            WITH {BOOKS}, {PIECES}, {SESSIONS}, {TASKS}
            SELECT 'books' AS metric, '' AS key, count(*) AS n FROM books
            UNION ALL SELECT 'chunks', '', count(*) FROM chunks UNION ALL SELECT 'sessions', '', count(*) FROM sessions
            UNION ALL SELECT 'books_by_status', status, count(*) FROM books GROUP BY status
            UNION ALL SELECT 'tasks_by_status', status, count(*) FROM tasks GROUP BY status
        """,
        "running_tasks": f"""
            WITH {TASKS} SELECT count(*) AS n FROM tasks
            WHERE type = 'ingest' AND dispatched_at IS NOT NULL AND status IN ('pending', 'processing')
        """,
        "book_info": f"""
            WITH {BOOKS} SELECT book_id, title || '/' || summary || '|more/' AS chapters FROM books
            WHERE title ILIKE '%src4%' OR author ILIKE '%src4%' ORDER BY created_at DESC, book_id LIMIT 5
        """,
        "summarize_state": f"""
            WITH {BOOKS} SELECT book_id, CASE WHEN summary <> '' AND created_at % 3 = 0 THEN 'done' WHEN summary <> '' THEN 'partial' ELSE 'none' END AS state FROM books
        """,
        "session_retention": f"""
            WITH {SESSIONS}, kept AS (
                SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, session_id) AS place FROM sessions) WHERE place <= 3
            )
            SELECT k.session_id, k.user_id, count(*) AS messages FROM kept k JOIN conversations c ON CAST(c.conv_id AS VARCHAR) = k.session_id
            GROUP BY k.session_id, k.user_id
        """,
        "orphan_chunks": f"WITH {PIECES} SELECT book_id || ':' || position AS chunk_id, book_id FROM chunks WHERE book_id IN ('3', '5', '8')",
        "metadata_fill_if_empty": f"""
            WITH {BOOKS} SELECT book_id,
                CASE WHEN status <> 'failed' AND title <> '' THEN title WHEN language = 'eng' THEN 'found' WHEN status = 'failed' THEN '' ELSE title END AS title,
                author, language FROM books
        """,
        "book_upsert_vectors": """
            WITH new AS (
                SELECT user_id * 3 AS id, CAST(event_id % 7 AS INTEGER) AS label, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events
            )
            SELECT id, label FROM new WHERE back = 1
            UNION ALL SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM new)
        """,
        "bulk_delete": """
            SELECT DISTINCT CAST(user_id * 11 AS VARCHAR) AS book_id, user_id * 11 IN (SELECT doc_id FROM documents) AS ok,
                CASE WHEN user_id * 11 IN (SELECT doc_id FROM documents) THEN '' ELSE 'book not found' END AS error
            FROM events
        """,
        "citation_percent": f"""
            {HYBRID}, best AS (SELECT * FROM fused WHERE score >= 0 ORDER BY score DESC, id LIMIT 5), {BOOKS}
            SELECT best.id, CASE WHEN best.book_id = 'src3' THEN 'src3' ELSE upper(best.book_id) END AS book_title,
                CASE WHEN b.language = 'eng' THEN b.title ELSE best.id END AS chapter_title, CAST(round(score * 100) AS INTEGER) AS percent
            FROM best JOIN books b ON b.book_id = best.id
        """,
        "book_lookup": f"WITH {BOOKS} SELECT book_id, title, status FROM books WHERE book_id = '17'",
        "session_owner": "SELECT count(*) > 0 AS owned FROM conversations WHERE conv_id = 3 AND conv_id % 10 = 3",
        "books_selected": f"WITH {BOOKS} SELECT book_id, status FROM books WHERE CAST(book_id AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1)",
        "keywords_shown": f"""
            WITH {topk(6)}, placed AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS n FROM top)
            SELECT doc_id, string_agg(term, ',' ORDER BY n) AS terms FROM placed WHERE n <= 3 GROUP BY doc_id
        """,
        "task_stage_log": f"""
            WITH {STEPS},
            logs AS (SELECT task_id, string_agg(stage || ':' || progress, ',' ORDER BY seq) AS log FROM steps GROUP BY task_id)
            SELECT s.task_id, status, CASE WHEN status = 'completed' THEN 100 ELSE progress END AS progress,
                CASE WHEN status = 'failed' THEN 'event ' || seq ELSE '' END AS error_msg, stage, log
            FROM steps s JOIN logs l ON s.task_id = l.task_id WHERE back = 1
        """,
        "task_final_state": FINAL,
        "dispatch_queue": f"""
            WITH {TASKS} SELECT task_id, created_at FROM tasks
            WHERE type = 'ingest' AND status = 'pending' AND dispatched_at IS NULL ORDER BY created_at, task_id LIMIT 4
        """,
        "orphan_recovery": f"""
            WITH {TASKS} SELECT task_id, type,
                CASE WHEN status IN ('pending', 'processing') THEN CASE type WHEN 'ingest' THEN 'pending' ELSE 'failed' END ELSE status END AS status,
                CASE WHEN status IN ('pending', 'processing') THEN 0 ELSE progress END AS progress,
                CASE WHEN status IN ('pending', 'processing') THEN CASE type WHEN 'ingest' THEN 'requeued' ELSE 'failed' END END AS logged,
                dispatched_at IS NULL OR (status IN ('pending', 'processing') AND type = 'ingest') AS queued
            FROM tasks
        """,
        "rate_limit_decisions": BUCKET,
        "stream_rate_limit": BUCKET,
        "progress_throttle": """
            WITH RECURSIVE req AS (
                SELECT CAST(user_id AS VARCHAR) AS client, event_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS ts,
                    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
                FROM events
            ),
            walk AS (
                SELECT client, event_id, ts, n, ts AS last, true AS through FROM req WHERE n = 1
                UNION ALL
                SELECT r.client, r.event_id, r.ts, r.n, CASE WHEN r.ts - w.last >= 3600 THEN r.ts ELSE w.last END, r.ts - w.last >= 3600
                FROM walk w JOIN req r ON r.client = w.client AND r.n = w.n + 1
            )
            SELECT client AS task_id, event_id AS seq FROM walk WHERE through
        """,
        "active_sessions_ttl": f"SELECT event_id FROM events WHERE ts + INTERVAL 24 HOURS > TIMESTAMP '{NOW}'",
        "chapters_list": "SELECT CAST(doc_id AS VARCHAR) AS chapter_id, CAST(doc_id % 7 AS INTEGER) AS sort_order, 't' || doc_id AS title FROM documents WHERE doc_id // 10 = 3",
        "tokens_of_user": f"WITH {TOKENS} SELECT CAST(event_id AS VARCHAR) AS token_id, created_at, is_revoked FROM tokens WHERE user_id = 7",
        "users_page": f"WITH {USERS} SELECT user_id, username, role, status FROM users ORDER BY created_at, user_id LIMIT 20 OFFSET 20",
        "queued_oldest": f"""
            WITH {TASKS} SELECT task_id, book_id FROM tasks
            WHERE type = 'ingest' AND status = 'pending' AND dispatched_at IS NULL ORDER BY created_at, task_id LIMIT 3
        """,
        "orphan_tasks": f"WITH {TASKS} SELECT task_id, status FROM tasks WHERE type = 'summarize' AND status IN ('pending', 'processing')",
        "tokens_valid": f"""
            WITH {TOKENS} SELECT CAST(event_id AS VARCHAR) AS token_id, expires_at FROM tokens
            WHERE NOT is_revoked AND coalesce(TRY_CAST(expires_at AS TIMESTAMP) > TIMESTAMP '{NOW}', true)
        """,
        "last_admin": f"WITH {USERS} SELECT count(*) = 0 AS last_admin FROM users WHERE role = 'admin' AND status = 'active' AND user_id <> '50'",
        "name_taken": "SELECT count(*) > 0 AS taken FROM customer WHERE c_name = 'Customer#000000007'",
        "book_cover": "SELECT count(*) > 0 AS has_cover FROM labels WHERE doc_id = 17 AND quality = 1",
        "active_task": f"""
            WITH {TASKS}, newest AS (SELECT * FROM tasks WHERE book_id = '7' ORDER BY created_at DESC, task_id LIMIT 5)
            SELECT task_id, status, CASE WHEN status = 'pending' AND type = 'ingest' AND dispatched_at IS NULL THEN 'queued'
                WHEN progress % 2 = 0 THEN 'embed' ELSE status END AS label
            FROM newest WHERE status IN ('pending', 'processing') ORDER BY created_at DESC, task_id LIMIT 1
        """,
        "book_detail": """
            SELECT 'b4' AS book_id, 't' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 60) ELSE '' END AS summary
            FROM documents WHERE doc_id // 10 = 4
        """,
        "book_tags": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a|t' || doc_id ELSE '' END AS tags FROM documents",
        "books_edited": f"""
            WITH {BOOKS} SELECT book_id, CASE WHEN status = 'failed' THEN 'new ' || book_id ELSE title END AS title, author,
                CASE WHEN status = 'failed' AND created_at % 2 = 1 THEN 'ita' ELSE language END AS language FROM books
        """,
        "users_upserted": f"""
            WITH {USERS}, last AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events)
            SELECT CAST(user_id AS VARCHAR) AS user_id, 'user' AS role, CASE WHEN event_type = 'error' THEN 'disabled' ELSE 'active' END AS status
            FROM last WHERE back = 1
            UNION ALL SELECT user_id, role, status FROM users WHERE CAST(user_id AS BIGINT) NOT IN (SELECT user_id FROM events)
        """,
        "parts_replaced": """
            SELECT source AS book_id, CASE WHEN source = 'src1' THEN 'new ' ELSE '' END || doc_id AS chapter_id FROM documents WHERE source <> 'src2'
        """,
        "audit_appended": """
            SELECT action, count(*) AS n, max(event_id) AS last FROM (
                SELECT event_type AS action, event_id FROM events UNION ALL SELECT 'seen', event_id FROM events WHERE event_type = 'error'
            ) GROUP BY action
        """,
        "status_map": f"""
            WITH {BOOKS}, n AS (SELECT status, count(*) AS n FROM books GROUP BY status)
            SELECT string_agg(status || '=' || n, ',' ORDER BY status) AS by_status, CAST(sum(n) AS BIGINT) AS total FROM n
        """,
        "book_states": f"""
            WITH {BOOKS}, {TASKS}, last AS (
                SELECT book_id, arg_max({STATE}, CAST(task_id AS BIGINT)) AS new FROM tasks WHERE type = 'ingest' GROUP BY book_id
            )
            SELECT b.book_id, coalesce(new, status) AS status FROM books b LEFT JOIN last l ON b.book_id = l.book_id
        """,
        "tasks_retried": f"""
            WITH {TASKS}, t AS (SELECT *, CAST(task_id AS BIGINT) < 60 AND status = 'failed' AS again FROM tasks)
            SELECT task_id, CASE WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN again THEN 0 ELSE progress END AS progress,
                again OR dispatched_at IS NULL AS queued FROM t
        """,
        "progress_values": """
            SELECT event_id, CAST(least(60 + 35 * d // greatest(t, 1), 95) AS INTEGER) AS ingest, CAST(5 + 80 * d // greatest(t, 1) AS INTEGER) AS summarize
            FROM (SELECT event_id, event_id % 40 AS d, user_id % 40 AS t FROM events)
        """,
        "chunk_search": f"""
            WITH cut AS (
                SELECT doc_id, s, {strip("substring(text, s + 1, 500)")} AS content FROM (
                    SELECT doc_id, text, unnest(range(0, length(text), 450)) AS s FROM (SELECT doc_id, {strip(tidy_text)} AS text FROM documents)
                )
            ),
            corpus AS (
                SELECT doc_id || ':' || position AS id, CAST(doc_id AS VARCHAR) AS book_id, position, content FROM (
                    SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS position FROM cut WHERE content <> ''
                )
            ),
            {bm25('corpus', CHUNK_QUERY)}, {KEYWORD},
            vec AS (SELECT id, list_cosine_similarity({_hashed("content")}, {_hashed(f"'{CHUNK_QUERY}'")}) AS v FROM corpus), {FUSED}
            SELECT f.id, f.book_id, CAST(c.position AS INTEGER) AS position, round(f.score, 6) AS score
            FROM fused f JOIN corpus c ON f.id = c.id WHERE f.score >= 0 ORDER BY f.score DESC, f.id LIMIT 10
        """,
        "stream_sessions": """
            WITH RECURSIVE req AS (
                SELECT CAST(user_id AS VARCHAR) AS client, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS ts,
                    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
                FROM events
            ),
            walk AS (
                SELECT client, n, ts AS opened_at FROM req WHERE n = 1
                UNION ALL
                SELECT r.client, r.n, CASE WHEN r.ts >= w.opened_at + 86400 THEN r.ts ELSE w.opened_at END
                FROM walk w JOIN req r ON r.client = w.client AND r.n = w.n + 1
            ),
            opened AS (SELECT client, opened_at, count(*) AS n FROM walk GROUP BY client, opened_at)
            SELECT client, round(opened_at, 6) AS opened_at, n FROM opened o
            WHERE opened_at < (SELECT max(opened_at) FROM opened p WHERE p.client = o.client)
        """,
        "stream_sessions_ended": """
            WITH RECURSIVE req AS (
                SELECT CAST(user_id AS VARCHAR) AS client, epoch_us(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
            ),
            walk AS (
                SELECT client, n, ts AS opened_at FROM req WHERE n = 1
                UNION ALL
                SELECT r.client, r.n, CASE WHEN r.ts >= w.opened_at + 86400000000 THEN r.ts ELSE w.opened_at END
                FROM walk w JOIN req r ON r.client = w.client AND r.n = w.n + 1
            ),
            opened AS (SELECT client, opened_at, count(*) AS n FROM walk GROUP BY client, opened_at)
            SELECT client, opened_at, n FROM opened o
            WHERE opened_at < (SELECT max(opened_at) FROM opened p WHERE p.client = o.client)
                OR ceil((opened_at + 86400000000) / 1000.0) <= (SELECT max(ts) // 1000 FROM req) - 3600000
        """,
        "stream_lost_tasks": LOST,
        "lost_tasks": LOST,
        "stream_task_states": FINAL,
    }

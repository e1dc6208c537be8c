"""SQL of the operators over words, written from their contracts."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: crc32 of each distinct word, byte by byte over the table that its polynomial gives.
CRC = """
    crc_table AS (
        SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([n], range(0, 8)), lambda c, i:
            CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c // 2) ELSE c // 2 END)) AS crcs
    ),
    coded AS (
        SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i:
            CAST('0x' || substring(hex(encode(w)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS bytes
        FROM (SELECT DISTINCT w FROM every)
    ),
    hashed AS (
        SELECT w, xor(CAST(4294967295 AS BIGINT), list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda c, b:
            xor(crcs[xor(c, b) % 256 + 1], c // 256))) % 10000 AS bucket
        FROM coded, crc_table
    )
"""

RESAMPLE = f"""
    WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
    dw AS (SELECT uid, unnest(words) AS w FROM d),
    bw AS (SELECT unnest({WORDS.format("coalesce(text, '')")}) AS w FROM benchmark),
    every AS (SELECT w FROM dw UNION ALL SELECT w FROM bw),
    {CRC},
    s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY bucket),
    gains AS (
        SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM dw) + 10000 AS DOUBLE)
            / (CAST(s + 1 AS DOUBLE) * CAST((SELECT count(*) FROM bw) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
        FROM s LEFT JOIN t ON s.bucket = t.bucket
    ),
    sums AS (SELECT uid, CAST(sum(gain) AS DOUBLE) AS total FROM dw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY uid),
    weighed AS (
        SELECT d.uid, doc_id, CAST(len(words) AS BIGINT) AS n_features,
            CASE WHEN len(words) = 0 THEN 0 ELSE CAST(floor(total / len(words)) AS BIGINT) END AS weight,
            CAST('0x' || substring(sha256('{2024}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
        FROM d LEFT JOIN sums ON d.uid = sums.uid
    ),
    scored AS (
        SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM weighed
    ),
    ranked AS (
        SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, uid) AS rank, count(*) OVER () AS n
        FROM scored WHERE n_features >= 20
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n // 10 THEN rank END AS rank
    FROM scored LEFT JOIN ranked ON scored.uid = ranked.uid
"""

CONTAMINATED = f"""
    WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
    b AS (SELECT item_id, {WORDS.format("coalesce(text, '')")} AS words FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, words[i + 1 : i + least(len(words), 10)] AS phrase
        FROM (SELECT item_id, words, unnest(range(0, greatest(len(words) - 9, 1))) AS i FROM b WHERE len(words) > 0)
    ),
    sizes AS (SELECT DISTINCT len(phrase) AS size FROM windows),
    firsts AS (SELECT DISTINCT phrase[1] AS w FROM windows),
    places AS (SELECT uid, words, unnest(words) AS w, unnest(range(0, len(words))) AS i FROM d),
    starts AS (SELECT uid, i, size, words[i + 1 : i + size] AS phrase FROM places JOIN firsts USING (w), sizes WHERE i + size <= len(words)),
    hits AS (SELECT DISTINCT s.uid, s.i, s.size, w.item_id FROM starts s JOIN windows w ON s.phrase = w.phrase),
    hit_words AS (SELECT uid, count(DISTINCT place) AS n_hit FROM (SELECT uid, unnest(range(i, i + size)) AS place FROM hits) GROUP BY uid),
    items AS (
        SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
        FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY uid
    )
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit_words ON d.uid = hit_words.uid LEFT JOIN items ON d.uid = items.uid
"""


def _phrases() -> str:
    return " UNION ALL ".join(
        f"SELECT lang, array_to_string(words[i + 1 : i + {k}], ' ') AS phrase, {k} AS k, count(*) AS f FROM spots "
        f"WHERE i + {k} <= len(words) GROUP BY ALL"
        for k in range(1, 6)
    )


COLLOCATIONS = rf"""
    WITH pieces AS (
        SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)
    ),
    spots AS (
        SELECT lang, words, unnest(range(0, len(words))) AS i FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces)
    ),
    counted AS ({_phrases()}),
    frequent AS (SELECT * FROM counted WHERE f >= 100),
    total AS (SELECT lang, count(*) AS n FROM spots GROUP BY lang),
    cuts AS (
        SELECT lang, phrase, k, f, string_split(phrase, ' ') AS parts, unnest(range(1, k)) AS cut FROM frequent WHERE k > 1
    ),
    scored AS (
        SELECT c.lang, c.phrase, c.k, c.f AS a, c.cut, x.f AS l, y.f AS r, n,
            CAST(1000 AS HUGEINT) * c.f * n // (CAST(x.f AS HUGEINT) * y.f) AS score
        FROM cuts c JOIN total USING (lang)
        JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(parts[1 : cut], ' ')
        JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(parts[cut + 1 : ], ' ')
    ),
    least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    inner_parts AS (
        SELECT lang, array_to_string(parts[1 : k - 1], ' ') AS phrase, f FROM cuts
        UNION ALL SELECT lang, array_to_string(parts[2 : ], ' '), f FROM cuts
    ),
    covered AS (SELECT lang, phrase, max(f) AS most FROM inner_parts GROUP BY lang, phrase),
    kept AS (
        SELECT s.* FROM least_cut s LEFT JOIN covered c ON s.lang = c.lang AND s.phrase = c.phrase WHERE c.most IS NULL OR 100 * c.most < 100 * s.a
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

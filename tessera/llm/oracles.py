"""DuckDB SQL for the operators whose whole result SQL can state.

The statements follow the definitions, not the operators' methods: every window of 50 words, every
pair of vectors of a label, every item against every document, one global order of all rows.
"""

#: Every window of every document; a word goes if the last lost window that starts at or before it still covers it.
OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
win AS (SELECT doc_id, p, md5(array_to_string(words[p:p + 49], ' ')) AS h
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM d)),
owner AS (SELECT h, min(doc_id) AS lowest FROM win GROUP BY h),
lost AS (SELECT win.doc_id, win.p FROM win JOIN owner USING (h) WHERE win.doc_id > owner.lowest),
marked AS (SELECT pos.doc_id, pos.p, pos.word,
                  max(lost.p) OVER (PARTITION BY pos.doc_id ORDER BY pos.p) AS last_lost
           FROM pos LEFT JOIN lost ON pos.doc_id = lost.doc_id AND pos.p = lost.p),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM marked
         WHERE last_lost IS NULL OR last_lost < p - 49 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words,
       CAST(len(d.words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: The order of all rows by fractional rank, numbered by plain windows.  A CRC-32 is a fold over the bytes with
#: the table of its polynomial.
OP6 = r"""
WITH crc_table AS (
    SELECT list(list_reduce(list_concat([n], [1, 1, 1, 1, 1, 1, 1, 1]),
                            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS steps
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)),
bytes AS (SELECT text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS codes
          FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
sums AS (SELECT text, xor(list_reduce(list_concat([4294967295], codes),
                                      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
         FROM bytes, crc_table),
d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, text_crc32,
             md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS h
      FROM documents LEFT JOIN sums USING (text)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS r,
                  count(*) OVER (PARTITION BY source) AS n,
                  CAST('0x' || substr(md5('42|' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 10) AS BIGINT)
                  / 1099511627776.0::DOUBLE AS offs
           FROM d),
placed AS (SELECT *, row_number() OVER (ORDER BY (r + offs) / n, coalesce(source, ''), source IS NULL, r) - 1 AS rank,
                  count(*) OVER () AS total
           FROM ranked)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(rank * 16 // total AS INTEGER) AS shard,
       CAST(rank - ((rank * 16 // total) * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed
"""

#: Every pair of a label; components by following the links until no smaller id comes.
OP7 = r"""
WITH RECURSIVE good AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id, b.vec_id AS other FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(vec_id, low) AS (
    SELECT vec_id, vec_id FROM good
    UNION
    SELECT links.vec_id, reach.low FROM reach JOIN links ON links.other = reach.vec_id WHERE reach.low < links.vec_id),
lowest AS (SELECT vec_id, min(low) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT vec_id, count(*) AS n_links FROM links GROUP BY vec_id)
SELECT e.vec_id, CAST(coalesce(degree.n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN lowest USING (vec_id) LEFT JOIN degree USING (vec_id)
"""

#: Distinct word 5-grams (a shorter text: its whole sequence) of every item and every document.
OP10 = r"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts WHERE text IS NOT NULL),
grams AS (SELECT DISTINCT side, id, w[p:p + 4] AS g
          FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM words WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM grams WHERE side = 'i' GROUP BY id),
shared AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
           FROM grams d JOIN grams i ON d.g = i.g AND d.side = 'd' AND i.side = 'i' GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n AS n_item, round(n_shared / n, 6) AS containment
FROM shared JOIN sizes ON sizes.id = item_id WHERE n_shared >= 0.8 * n - 1e-9
"""

#: Lines, cuts and both digests of every document; the cuts come from the digest of ``7:`` and the id.
OP11 = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
lines AS (SELECT doc_id, t, CASE WHEN t = '' THEN []::VARCHAR[] ELSE regexp_extract_all(t, '[^\n]*\n|[^\n]+') END AS u,
                 ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                 ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM drawn),
cuts AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                     WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM lines),
parts AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid,
                 coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

SQL = {"op1_substring_dedup": OP1, "op6_interleaved_shards": OP6, "op7_embedding_near_dups": OP7, "op10_decontamination": OP10,
       "op11_fill_in_middle": OP11}

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), kept AS (
    SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, payload_bytes, p.payload_digest,
       CASE WHEN original IS DISTINCT FROM page_id AND original IS NOT NULL THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN original IS DISTINCT FROM page_id THEN original END AS refers_to
FROM p LEFT JOIN kept ON p.payload_digest = kept.payload_digest AND p.payload_bytes >= 1000
"""

OP4 = r"""
WITH RECURSIVE nodes AS (
    SELECT row_number() OVER () AS id, text, least, copies, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words
    FROM (SELECT text, min(doc_id) AS least, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text)
), grams AS (
    SELECT DISTINCT id, array_to_string(words[i:i + 4], ' ') AS gram
    FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM nodes WHERE len(words) > 0)
), sizes AS (
    SELECT id, count(*) AS size FROM grams GROUP BY id
), pairs AS (
    SELECT a.id AS a, b.id AS b, count(*) AS common FROM grams a JOIN grams b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL
), half AS (
    SELECT a, b FROM pairs JOIN sizes x ON a = x.id JOIN sizes y ON b = y.id WHERE 9 * common >= 4 * (x.size + y.size)
), links AS (
    SELECT a, b FROM half UNION ALL SELECT b, a FROM half
), reach AS (
    SELECT id AS root, id FROM nodes
    UNION
    SELECT root, b FROM reach JOIN links ON reach.id = links.a
), classes AS (
    SELECT reach.id, min(least) AS class_id FROM reach JOIN nodes ON nodes.id = reach.root GROUP BY reach.id
)
SELECT doc_id, class_id, least AS copy_of, copies AS n_copies, coalesce(n, 0) AS n_links
FROM documents JOIN nodes USING (text) JOIN classes USING (id)
LEFT JOIN (SELECT a AS id, count(*) AS n FROM links GROUP BY a) USING (id)
UNION ALL
SELECT doc_id, doc_id, doc_id, 1, 0 FROM documents WHERE text IS NULL
"""

OP6 = r"""
WITH RECURSIVE said AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT) + 8 AS cost
    FROM said
), placed AS (
    SELECT *, row_number() OVER w - 1 AS place, sum(cost) OVER w - cost AS start
    FROM turns
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
), headed AS (
    SELECT p.*, start // 32768 AS block, coalesce(h.cost, 0) AS sys, CASE WHEN place > 0 THEN coalesce(h.cost, 0) ELSE 0 END AS again,
           length(regexp_replace(p.role, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g'))
             + length(regexp_replace(p.text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) + 9 AS chars,
           CASE WHEN p.role = 'assistant' THEN 4 ELSE 7 END AS closing
    FROM placed p
    LEFT JOIN (SELECT conv_id, cost FROM placed WHERE place = 0 AND role = 'system') h ON p.conv_id IS NOT DISTINCT FROM h.conv_id
), asked AS (
    SELECT *, list_filter(list({'s': start, 'p': place}) OVER (
             PARTITION BY conv_id ORDER BY start RANGE BETWEEN 512 PRECEDING AND 1 PRECEDING),
             lambda t: t.s >= start - least(512, 2048 - again - cost) AND (t.p > 0 OR sys = 0)) AS before
    FROM headed
), rooms AS (
    SELECT *, coalesce(list_min(before).p, place) AS back,
           greatest(start + cost, 2048 - again + coalesce(list_min(before).s, start)) AS until
    FROM asked
), walk AS (
    SELECT conv_id, place, place AS win, until, block FROM rooms WHERE place = 0
    UNION ALL
    SELECT r.conv_id, r.place, CASE WHEN r.block = w.block AND r.start + r.cost <= w.until THEN w.win ELSE r.place END,
           CASE WHEN r.block = w.block AND r.start + r.cost <= w.until THEN w.until ELSE r.until END, r.block
    FROM walk w JOIN rooms r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.place = w.place + 1
), windowed AS (
    SELECT r.*, win FROM rooms r JOIN walk w ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.place = w.place
), spans AS (
    SELECT conv_id, place, back, again FROM windowed WHERE win = place
), lengths AS (
    SELECT conv_id, chars + closing AS chars FROM windowed
    UNION ALL
    SELECT t.conv_id, t.chars + 7 FROM windowed t
    JOIN spans s ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.place >= s.back AND t.place < s.place
    UNION ALL
    SELECT t.conv_id, t.chars + 7 FROM windowed t
    JOIN spans s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
    WHERE t.place = 0 AND s.again > 0
), digests AS (
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256
    FROM windowed GROUP BY conv_id
)
SELECT d.conv_id, d.n_turns, d.turns_sha256, CAST(d.loss_chars AS BIGINT) AS loss_chars, d.loss_sha256,
       CAST(l.chars AS BIGINT) AS formatted_chars, s.n AS n_windows
FROM digests d
JOIN (SELECT conv_id, sum(chars) AS chars FROM lengths GROUP BY conv_id) l ON d.conv_id IS NOT DISTINCT FROM l.conv_id
JOIN (SELECT conv_id, count(*) AS n FROM spans GROUP BY conv_id) s ON d.conv_id IS NOT DISTINCT FROM s.conv_id
"""

OP8 = """
WITH docs AS (
    SELECT row_number() OVER () AS nr, doc_id, hex(encode(coalesce(text, ''))) AS hexed FROM documents
), strings AS (
    SELECT nr, doc_id, i, substr(hexed, 2 * i + 1, 100) AS s
    FROM (SELECT nr, doc_id, hexed, unnest(range(0, length(hexed) // 2 - 49)) AS i FROM docs WHERE doc_id IS NOT NULL)
), gone AS (
    SELECT nr, i FROM strings JOIN (SELECT s, min(doc_id) AS least FROM strings GROUP BY s) USING (s) WHERE least < doc_id
), spans AS (
    SELECT nr, min(i) AS a, max(i) + 50 AS b
    FROM (SELECT nr, i, sum(opens) OVER (PARTITION BY nr ORDER BY i) AS span
          FROM (SELECT nr, i, CASE WHEN i <= lag(i) OVER (PARTITION BY nr ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM gone))
    GROUP BY nr, span
), pieces AS (
    SELECT nr, a, b, substr(hexed, 2 * past + 1, 2 * (a - past)) AS piece
    FROM (SELECT nr, a, b, coalesce(lag(b) OVER (PARTITION BY nr ORDER BY a), 0) AS past FROM spans) JOIN docs USING (nr)
)
SELECT doc_id, length(hexed) // 2 AS n_bytes, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(a) AS n_spans,
       sha256(unhex(coalesce(string_agg(piece, '' ORDER BY a), '') || substr(hexed, 2 * coalesce(max(b), 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN pieces USING (nr)
GROUP BY nr, doc_id, hexed
"""

OP10 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP9 = """
WITH docs AS (
    SELECT *, ceil(strlen(coalesce(text, '')) / 4.0)::BIGINT AS tokens,
           'd' || (TRY_CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 4) AS domain
    FROM documents
), leaves AS (
    SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, 2 * sum(tokens)::BIGINT AS capacity
    FROM docs WHERE tokens > 0 GROUP BY ALL
), rooted AS (
    SELECT *, least(sum(tokens) OVER () * 3 // 5, sum(capacity) OVER ())::BIGINT AS given FROM leaves
), a_nodes AS (
    SELECT domain, sum(capacity)::HUGEINT AS capacity, max(given)::HUGEINT AS given, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END::HUGEINT AS weight,
           coalesce(domain, '') AS name
    FROM rooted GROUP BY domain
), a_ranked AS (
    SELECT *, given - coalesce(sum(capacity) OVER b, 0) AS room,
           sum(weight) OVER f - coalesce(sum(weight) OVER b, 0) AS weight_left
    FROM a_nodes
    WINDOW f AS (PARTITION BY 1),
           b AS (PARTITION BY 1 ORDER BY capacity::DOUBLE / weight::DOUBLE, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), a_open AS (
    SELECT *, given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER f AS rest,
           sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER f AS weight_open,
           sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER l AS nth
    FROM (SELECT *, capacity * weight_left <= room * weight AS is_full FROM a_ranked)
    WINDOW f AS (PARTITION BY 1),
           l AS (PARTITION BY 1 ORDER BY capacity::DOUBLE / weight::DOUBLE, name ROWS UNBOUNDED PRECEDING)
), a_parts AS (
    SELECT *, given - sum(part) OVER (PARTITION BY 1) AS over_
    FROM (SELECT *, CASE WHEN is_full THEN capacity ELSE (rest * weight)::HUGEINT // weight_open::HUGEINT END AS part
          FROM a_open)
), a_given AS (
    SELECT t.domain, t.lang, t.source, t.tokens, t.capacity,
           (p.part + CASE WHEN NOT p.is_full AND p.nth <= p.over_ THEN 1 ELSE 0 END)::BIGINT AS given
    FROM rooted t JOIN a_parts p ON t.domain IS NOT DISTINCT FROM p.domain
), b_nodes AS (
    SELECT domain, lang, sum(capacity)::HUGEINT AS capacity, max(given)::HUGEINT AS given, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END::HUGEINT AS weight,
           coalesce(lang, '') AS name
    FROM a_given GROUP BY domain, lang
), b_ranked AS (
    SELECT *, given - coalesce(sum(capacity) OVER b, 0) AS room,
           sum(weight) OVER f - coalesce(sum(weight) OVER b, 0) AS weight_left
    FROM b_nodes
    WINDOW f AS (PARTITION BY domain),
           b AS (PARTITION BY domain ORDER BY capacity::DOUBLE / weight::DOUBLE, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), b_open AS (
    SELECT *, given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER f AS rest,
           sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER f AS weight_open,
           sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER l AS nth
    FROM (SELECT *, capacity * weight_left <= room * weight AS is_full FROM b_ranked)
    WINDOW f AS (PARTITION BY domain),
           l AS (PARTITION BY domain ORDER BY capacity::DOUBLE / weight::DOUBLE, name ROWS UNBOUNDED PRECEDING)
), b_parts AS (
    SELECT *, given - sum(part) OVER (PARTITION BY domain) AS over_
    FROM (SELECT *, CASE WHEN is_full THEN capacity ELSE (rest * weight)::HUGEINT // weight_open::HUGEINT END AS part
          FROM b_open)
), b_given AS (
    SELECT t.domain, t.lang, t.source, t.tokens, t.capacity,
           (p.part + CASE WHEN NOT p.is_full AND p.nth <= p.over_ THEN 1 ELSE 0 END)::BIGINT AS given
    FROM a_given t JOIN b_parts p ON t.domain IS NOT DISTINCT FROM p.domain AND t.lang IS NOT DISTINCT FROM p.lang
), c_nodes AS (
    SELECT domain, lang, source, sum(capacity)::HUGEINT AS capacity, max(given)::HUGEINT AS given, 1::HUGEINT AS weight,
           coalesce(source, '') AS name
    FROM b_given GROUP BY domain, lang, source
), c_ranked AS (
    SELECT *, given - coalesce(sum(capacity) OVER b, 0) AS room,
           sum(weight) OVER f - coalesce(sum(weight) OVER b, 0) AS weight_left
    FROM c_nodes
    WINDOW f AS (PARTITION BY domain, lang),
           b AS (PARTITION BY domain, lang ORDER BY capacity::DOUBLE / weight::DOUBLE, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c_open AS (
    SELECT *, given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER f AS rest,
           sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER f AS weight_open,
           sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER l AS nth
    FROM (SELECT *, capacity * weight_left <= room * weight AS is_full FROM c_ranked)
    WINDOW f AS (PARTITION BY domain, lang),
           l AS (PARTITION BY domain, lang ORDER BY capacity::DOUBLE / weight::DOUBLE, name ROWS UNBOUNDED PRECEDING)
), c_parts AS (
    SELECT *, given - sum(part) OVER (PARTITION BY domain, lang) AS over_
    FROM (SELECT *, CASE WHEN is_full THEN capacity ELSE (rest * weight)::HUGEINT // weight_open::HUGEINT END AS part
          FROM c_open)
), c_given AS (
    SELECT t.domain, t.lang, t.source, t.tokens, t.capacity,
           (p.part + CASE WHEN NOT p.is_full AND p.nth <= p.over_ THEN 1 ELSE 0 END)::BIGINT AS given
    FROM b_given t JOIN c_parts p ON t.domain IS NOT DISTINCT FROM p.domain AND t.lang IS NOT DISTINCT FROM p.lang AND t.source IS NOT DISTINCT FROM p.source
), read AS (
    SELECT d.*, e.epoch, l.given, l.tokens AS leaf_tokens,
           md5(concat_ws('|', '7', e.epoch, coalesce(d.doc_id::VARCHAR, ''), d.tokens)) AS place
    FROM docs d
    JOIN c_given l ON d.domain IS NOT DISTINCT FROM l.domain AND d.lang IS NOT DISTINCT FROM l.lang
                  AND d.source IS NOT DISTINCT FROM l.source
    JOIN (SELECT unnest([0, 1, 2]) AS epoch) e ON e.epoch * l.tokens < l.given
    WHERE d.tokens > 0
)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, tokens
FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place, md5(text)
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM read)
WHERE epoch * leaf_tokens + before < given
"""

OP13 = r"""
WITH read AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), occurring AS (
    SELECT id, lang, source, unnest(terms) AS term FROM read
), kept AS (
    SELECT lang, term FROM (SELECT DISTINCT id, lang, term FROM occurring) GROUP BY lang, term HAVING count(*) >= 10
), groups AS (
    SELECT DISTINCT lang, source FROM read
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM occurring GROUP BY ALL
), grid AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
    FROM groups g JOIN kept k ON g.lang = k.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
    SELECT lang, source, term, n,
           (1 + (1000000000 * (n + 2))::HUGEINT // (sum(n) OVER w + 2 * count(*) OVER w))::BIGINT AS p
    FROM grid WINDOW w AS (PARTITION BY lang, source)
), of_lang AS (
    SELECT lang, term, (1 + (1000000000 * (n + 2))::HUGEINT // (sum(n) OVER w + 2 * count(*) OVER w))::BIGINT AS q
    FROM (SELECT lang, term, sum(n) AS n FROM grid GROUP BY ALL) WINDOW w AS (PARTITION BY lang)
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q)
    FROM shares JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_revisits": OP1, "op4_jaccard_classes": OP4, "op6_chat_windows": OP6,
            "op8_repeated_bytes": OP8, "op9_hierarchical_mix": OP9,
            "op10_maxscore_topk": OP10, "op13_source_divergence": OP13}

"""SQL (DuckDB) for the rows of the registered queries, where SQL can express them."""

SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op1_decontaminate": r"""
        WITH iw AS (
          SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id,
                 regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
          FROM benchmark),
        win AS (
          SELECT DISTINCT item_id, least(len(words), 13) AS m, array_to_string(words[o:o + least(len(words), 13) - 1], ' ') AS win
          FROM (SELECT item_id, words, unnest(generate_series(1, len(words) - least(len(words), 13) + 1)) AS o FROM iw WHERE len(words) > 0) t),
        sizes AS (SELECT DISTINCT m FROM win),
        dw AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
          FROM documents),
        runs AS (
          SELECT doc_id, m, p, array_to_string(words[p:p + m - 1], ' ') AS win
          FROM (SELECT doc_id, words, m, unnest(generate_series(1, len(words) - m + 1)) AS p FROM dw CROSS JOIN sizes WHERE len(words) >= m) t),
        occ AS (SELECT r.doc_id, r.p, r.m, w.item_id FROM runs r JOIN win w ON r.m = w.m AND r.win = w.win),
        hit AS (
          SELECT doc_id, count(DISTINCT q) AS n_hit
          FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + m - 1)) AS q FROM occ) t GROUP BY doc_id),
        named AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT doc_id, item_id FROM occ) t GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
               coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.words) AS contaminated
        FROM dw d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id""",
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        w AS (
          SELECT doc_id, p, md5(array_to_string(words[p:p + 49], ' ')) AS h
          FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS p FROM d WHERE len(words) >= 50) t),
        f AS (SELECT h, min(doc_id) AS least FROM w GROUP BY h),
        gone AS (
          SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS q FROM (SELECT w.doc_id, w.p FROM w JOIN f ON w.h = f.h WHERE f.least < w.doc_id) t),
        each AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS q FROM d WHERE len(words) > 0),
        kept AS (
          SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.q) AS text FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.q = g.q WHERE g.q IS NULL GROUP BY e.doc_id),
        lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(l.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM d LEFT JOIN lost l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        part AS (SELECT page_id, k, CAST('0x' || substr(hex, 5 * k + 1, 5) AS INTEGER) AS v FROM p, (SELECT unnest(generate_series(0, 7)) AS k) t),
        code AS (
          SELECT page_id, string_agg(substr(a, 1 + (v >> 15) % 32, 1) || substr(a, 1 + (v >> 10) % 32, 1) || substr(a, 1 + (v >> 5) % 32, 1) || substr(a, 1 + v % 32, 1), '' ORDER BY k) AS digest
          FROM (SELECT *, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a FROM part) t GROUP BY page_id),
        f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
        SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, c.digest AS payload_digest,
               CASE WHEN p.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN p.page_id <> f.first_id THEN f.first_id END AS refers_to
        FROM p JOIN code c ON p.page_id = c.page_id JOIN f ON p.html = f.html""",
    "op10_near_dedup": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (
          SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS sh
          FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS p FROM d WHERE len(words) > 0) t),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT DISTINCT x AS doc_id, x AS seen FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.seen = e.x),
        c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
        FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id""",
    "op6_mixing": r"""
        WITH RECURSIVE r AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
        s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs FROM r GROUP BY source),
        b AS (SELECT CAST(sum(tokens) AS DOUBLE) AS budget, 0.98 * ln(count(*) FILTER (WHERE tokens > 0)) AS goal FROM s),
        sh AS (SELECT source, tokens, docs, tokens / budget AS share FROM s, b WHERE tokens > 0),
        e1 AS (SELECT ln(sum(share)) - sum(share * ln(share)) / sum(share) >= (SELECT goal FROM b) AS fits FROM sh),
        bis AS (
          SELECT 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
          UNION ALL
          SELECT step + 1, CASE WHEN fits THEN (low + high) / 2 ELSE low END, CASE WHEN fits THEN high ELSE (low + high) / 2 END
          FROM (SELECT step, low, high,
                  (SELECT ln(sum(pow(share, (low + high) / 2))) - sum(pow(share, (low + high) / 2) * ln(pow(share, (low + high) / 2))) / sum(pow(share, (low + high) / 2)) FROM sh) >= (SELECT goal FROM b) AS fits
                FROM bis WHERE step < 40) t),
        a1 AS (SELECT CASE WHEN (SELECT fits FROM e1) THEN CAST(1 AS DOUBLE) ELSE low END AS a FROM bis WHERE step = 40),
        top AS (SELECT (SELECT max(pow(share, a) / tokens) FROM sh) * (SELECT budget FROM b) / (SELECT sum(pow(share, a)) FROM sh) > 4.0 AS over FROM a1),
        bis2 AS (
          SELECT 0 AS step, a AS low, CAST(1 AS DOUBLE) AS high FROM a1
          UNION ALL
          SELECT step + 1, CASE WHEN fits THEN low ELSE (low + high) / 2 END, CASE WHEN fits THEN (low + high) / 2 ELSE high END
          FROM (SELECT step, low, high,
                  (SELECT max(pow(share, (low + high) / 2) / tokens) FROM sh) * (SELECT budget FROM b) / (SELECT sum(pow(share, (low + high) / 2)) FROM sh) <= 4.0 AS fits
                FROM bis2 WHERE step < 40) t),
        ex AS (SELECT CASE WHEN (SELECT over FROM top) THEN (SELECT high FROM bis2 WHERE step = 40) ELSE (SELECT a FROM a1) END AS a),
        pl AS (
          SELECT source, tokens, own, n_blocks, own // tokens AS whole, own % tokens AS rest
          FROM (SELECT source, tokens, CAST(floor(pow(share, (SELECT a FROM ex)) / (SELECT sum(pow(share, (SELECT a FROM ex))) FROM sh) * (SELECT budget FROM b)) AS BIGINT) AS own,
                       CAST(greatest(1, ceil(docs / 256.0)) AS BIGINT) AS n_blocks FROM sh) t),
        placed AS (
          SELECT r.doc_id, r.source, r.n_tokens, p.whole, p.rest,
                 CAST('0x' || substr(md5('17:' || coalesce(CAST(r.doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % p.n_blocks AS block
          FROM r JOIN pl p ON r.source IS NOT DISTINCT FROM p.source),
        bl AS (
          SELECT source, block, in_block, whole, rest, epoch,
                 CAST('0x' || substr(md5('17:' || epoch || ':' || coalesce(source, '') || '/' || block), 1, 15) AS BIGINT) AS k
          FROM (SELECT source, block, in_block, whole, rest, unnest(generate_series(0, whole)) AS epoch
                FROM (SELECT source, block, sum(n_tokens) AS in_block, min(whole) AS whole, min(rest) AS rest FROM placed GROUP BY source, block) t) u),
        rk AS (
          SELECT *, row_number() OVER (PARTITION BY source, epoch ORDER BY k, block) AS block_rank,
                 sum(in_block) OVER (PARTITION BY source, epoch ORDER BY k, block ROWS UNBOUNDED PRECEDING) AS through FROM bl),
        room AS (SELECT *, CASE WHEN epoch < whole THEN in_block ELSE rest - through + in_block END AS room FROM rk),
        taken AS (
          SELECT p.doc_id, p.source, o.epoch, p.block, o.block_rank, p.n_tokens, o.room, o.in_block, o.whole,
                 CAST('0x' || substr(md5('17:' || o.epoch || ':' || coalesce(CAST(p.doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS doc_rank_key
          FROM placed p JOIN room o ON p.source IS NOT DISTINCT FROM o.source AND p.block = o.block WHERE o.room > 0 OR o.epoch < o.whole),
        cum AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, block, epoch ORDER BY doc_rank_key) AS so_far FROM taken)
        SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block, CAST(block_rank AS BIGINT) AS block_rank, doc_rank_key, n_tokens
        FROM cum WHERE room >= in_block OR so_far <= room""",
    "op11_negatives": """
        WITH v AS (
          SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
          SELECT a.rn AS anchor, a.vec_id AS anchor_id, a.label AS own, v.label, v.vec_id,
                 CAST(coalesce(list_sum(list_transform(range(1, least(len(a.q), len(v.q)) + 1), lambda i: a.q[i] * v.q[i])), 0) AS BIGINT) AS score
          FROM v a JOIN v ON a.rn <> v.rn WHERE a.vec_id % 100 = 0),
        p AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE label = own) t WHERE k <= 5),
        n AS (
          SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
          FROM p JOIN s ON s.anchor = p.anchor AND s.label <> s.own AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}

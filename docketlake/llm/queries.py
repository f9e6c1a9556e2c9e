"""The training-text operators as queries; their SQL where SQL can express them."""

from __future__ import annotations

from docketlake.llm import bpe, conversations, lines, neighbours, packing, phrases, pii, quality, rules, secrets, simhash, substring, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_bpe": bpe.op3_bpe,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_packing": packing.op5_packing,
    "op6_simhash": simhash.op6_simhash,
    "op7_lines": lines.op7_lines,
    "op8_substring": substring.op8_substring,
    "op9_pii": pii.op9_pii,
    "op10_rules": rules.op10_rules,
    "op11_conversations": conversations.op11_conversations,
    "op12_phrases": phrases.op12_phrases,
    "op13_secrets": secrets.op13_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op7_lines": """
        WITH whole AS (
            SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents
        ), lines AS (
            SELECT row, doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM whole
        ), keyed AS (
            SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), frequent AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
        FROM keyed LEFT JOIN frequent f USING (key) GROUP BY row, doc_id""",
    "op11_conversations": """
        WITH known AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, to_base64(unhex(sha256(strlen(role) || ':' || role || text)))) AS i FROM known
        ), heads AS (
            SELECT conv_id, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                   lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS state
            FROM (SELECT DISTINCT conv_id FROM known)
        ), convs AS (
            SELECT conv_id, xor(state, 4294967295) % 4 AS h FROM heads
        ), whole AS (
            SELECT c.conv_id, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.i <= c.h
            UNION ALL
            SELECT c.conv_id, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h
        ), placed AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth, role, text FROM whole
        ), prefixes AS (
            SELECT conv_id, depth, sha256(list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth)::VARCHAR || '|' || string_agg(strlen(role) || ':' || strlen(text), ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS key,
                   len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
            FROM placed
            UNION ALL
            SELECT conv_id, 0, 'root', 0 FROM convs
        ), nodes AS (
            SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM prefixes GROUP BY key, depth
        ), parents AS (
            SELECT DISTINCT a.key, b.key AS parent FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND b.depth = a.depth - 1
        ), children AS (
            SELECT parent, count(*) AS n FROM parents GROUP BY parent
        ), below AS (
            SELECT DISTINCT a.key AS top, b.key FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND b.depth >= a.depth
        ), sums AS (
            SELECT b.top, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
            FROM below b JOIN nodes n USING (key) LEFT JOIN children c ON c.parent = b.key GROUP BY b.top
        ), ends AS (
            SELECT p.key, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS digest
            FROM prefixes p JOIN (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id) USING (conv_id, depth) GROUP BY p.key
        )
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves,
               s.saved::BIGINT AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
        FROM nodes n LEFT JOIN parents p USING (key) LEFT JOIN nodes u ON u.key = p.parent LEFT JOIN children c ON c.parent = n.key
        JOIN sums s ON s.top = n.key LEFT JOIN ends e ON e.key = n.key""",
    "op12_phrases": """
        WITH whole AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents
        ), pieces AS (
            SELECT lang, regexp_extract_all(unnest(pieces), '[^\\x20\\x09]+') AS w FROM whole
        ), totals AS (
            SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
        ), starts AS (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
        ), grams AS (
            SELECT lang, k, list_slice(w, i, i + k - 1) AS p FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)
        ), counts AS (
            SELECT lang, k, array_to_string(p, ' ') AS phrase, any_value(p) AS p, count(*) AS f FROM grams GROUP BY lang, k, array_to_string(p, ' ')
        ), found AS (
            SELECT * FROM counts WHERE k > 1 AND f >= 30
        ), spans AS (
            SELECT b.lang, b.f, x.k, array_to_string(list_slice(b.p, x.i, x.i + x.k - 1), ' ') AS phrase
            FROM found b, (SELECT k, i FROM (SELECT unnest([2, 3]) AS k), (SELECT unnest([1, 2, 3]) AS i)) x WHERE x.k < b.k AND x.i + x.k - 1 <= b.k
        ), longer AS (
            SELECT lang, phrase, max(f) AS most FROM spans GROUP BY lang, phrase
        ), cuts AS (
            SELECT c.*, j, array_to_string(list_slice(c.p, 1, j), ' ') AS head, array_to_string(list_slice(c.p, j + 1, c.k), ' ') AS tail
            FROM found c, (SELECT unnest([1, 2, 3]) AS j) WHERE j < c.k
        ), scored AS (
            SELECT c.lang, c.phrase, c.f AS a, c.j, h.f AS l, t.f AS r, ((2000000::HUGEINT * c.f) // (h.f + t.f))::BIGINT AS score
            FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head AND h.k = c.j JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail AND t.k = c.k - c.j
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
        ), ranked AS (
            SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, s.score
            FROM lowest s LEFT JOIN longer x ON x.lang = s.lang AND x.phrase = s.phrase WHERE x.most IS NULL OR 100::HUGEINT * x.most < 80::HUGEINT * s.a
        )
        SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000""",
}

"""DuckDB SQL of the queries that SQL can express over whole tables."""


def _leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


ORACLES = {
    "op10_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), s AS (
            SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS start FROM w
        ), g AS (
            SELECT doc_id, start, sha256(array_to_string(words[start:start + 12], ' ')) AS gram FROM s
        ), c AS (
            SELECT doc_id, start FROM (SELECT doc_id, start, min(doc_id) OVER (PARTITION BY gram) AS smallest FROM g) WHERE doc_id > smallest
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(start, start + 13)) AS pos FROM c
        ), p AS (
            SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w
        ), k AS (
            SELECT p.doc_id, p.pos, p.word, gone.pos IS NOT NULL AS removed FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.pos = gone.pos
        ), a AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed,
                   coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT removed), '') AS kept
            FROM k GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(a.n_words, 0) AS n_words, coalesce(a.n_removed, 0) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
    """,
    "op3_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), k AS (
            SELECT doc_id, pos, line,
                   translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ), f AS (
            SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), d AS (
            SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.largest AS gone FROM k LEFT JOIN f ON k.key = f.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM d GROUP BY doc_id
    """,
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)
    """,
    "op13_merkle_manifest": rf"""
        WITH RECURSIVE crc AS (
            SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
            FROM (SELECT DISTINCT doc_id FROM documents)
        ), leaves AS (
            SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN crc % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place
            FROM documents JOIN crc USING (doc_id)
        ), tree AS (
            SELECT place, 0 AS lvl, pos AS idx, leaf AS node FROM leaves
            UNION ALL
            SELECT place, lvl + 1, idx // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY place) AS n FROM tree) WHERE n > 1 GROUP BY place, lvl, idx // 16
        ), subs AS (
            SELECT place, max(lvl) AS height, arg_max(node, lvl) AS subroot FROM tree GROUP BY place
        ), top AS (
            SELECT 0 AS lvl, place AS idx, subroot AS node FROM subs
            UNION ALL
            SELECT lvl + 1, idx // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY lvl, idx // 16
        ), root AS (
            SELECT max(lvl) AS tall, arg_max(node, lvl) AS root FROM top
        ), near AS (
            SELECT l.doc_id, t.lvl AS step, t.idx, t.node, l.pos // (16 ** t.lvl)::BIGINT AS own FROM leaves l JOIN subs USING (place) JOIN tree t ON t.place = l.place AND t.lvl < height AND t.idx // 16 = l.pos // (16 ** (t.lvl + 1))::BIGINT
            UNION ALL
            SELECT l.doc_id, height + t.lvl, t.idx, t.node, l.place // (16 ** t.lvl)::BIGINT FROM leaves l JOIN subs USING (place) CROSS JOIN root JOIN top t ON t.lvl < tall AND t.idx // 16 = l.place // (16 ** (t.lvl + 1))::BIGINT
        ), path AS (
            SELECT doc_id, step, coalesce(string_agg(node, '' ORDER BY idx) FILTER (WHERE idx < own), '') AS before, coalesce(string_agg(node, '' ORDER BY idx) FILTER (WHERE idx > own), '') AS after
            FROM near GROUP BY doc_id, step
        ), fold AS (
            SELECT doc_id, 0 AS step, coalesce(changed, leaf) AS node FROM leaves
            UNION ALL
            SELECT f.doc_id, f.step + 1, sha256(before || node || after) FROM fold f JOIN path p ON p.doc_id = f.doc_id AND p.step = f.step
        ), folded AS (
            SELECT doc_id, arg_max(node, step) AS folded_root FROM fold GROUP BY doc_id
        ), proof AS (
            SELECT doc_id, string_agg(before || after, '' ORDER BY step) AS siblings FROM path GROUP BY doc_id
        )
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM leaves JOIN subs USING (place) CROSS JOIN root JOIN folded USING (doc_id) LEFT JOIN proof USING (doc_id)
    """,
}

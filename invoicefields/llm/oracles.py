"""Check SQL of the operators that SQL can express, over the same tables.

What SQL cannot express is held against brute force, round trips or held-out labels in the tests:
op5, op10 and op11 (learned), op6 (a tokenizer), op7 (spans that its tests add), op8 (a media format).
"""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS = r"'[^\x20\x09-\x0D]+'"
ITEM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATION = f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, {ITEM_WORDS}) AS ws FROM benchmark
), cut AS (
  SELECT item_id, ws, least(10, len(ws)) AS size FROM item WHERE len(ws) > 0
), item_window AS (
  SELECT DISTINCT size, array_to_string(ws[i:i + size - 1], ' ') AS w, item_id
  FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM cut)
), doc AS (
  SELECT doc_id, regexp_extract_all({LOWER}, {ITEM_WORDS}) AS ws FROM documents
), doc_window AS (
  SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS w
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
        FROM doc, (SELECT DISTINCT size FROM item_window) WHERE len(ws) >= size)
), found AS (
  SELECT d.doc_id, d.size, d.i, b.item_id FROM doc_window d JOIN item_window b ON d.size = b.size AND d.w = b.w
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, size, i FROM found)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

MINHASH = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({LOWER}, {PLAIN_WORDS}) AS ws FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM doc WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), sized AS (
  SELECT s.doc_id, s.s, z.n FROM shingle s JOIN sizes z USING (doc_id)
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id != b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM doc
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other
)
SELECT r.doc_id, CAST(coalesce(any_value(z.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id,
       r.doc_id = min(r.other) AS kept
FROM reach r LEFT JOIN sizes z USING (doc_id) GROUP BY r.doc_id
"""

_ESCAPED = (r"regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(\||/?s>)', '<\\\1', 'g'),"
            r" '\[(/?INST\])', '[\\\1', 'g')")
CHAT = f"""
WITH turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), said AS (
  SELECT *, length('<|turn|><|says|><|end|>') + length({_ESCAPED.format('role')})
            + length({_ESCAPED.format('text')}) AS formatted FROM turn
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

SUBSTRINGS = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {PLAIN_WORDS}) AS ws FROM documents
), word AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i,
         unnest(list_transform(range(1, len(ws) - 48), lambda j: sha256(array_to_string(ws[j:j + 49], ' ')))) AS win
  FROM doc
), first AS (
  SELECT win, min(doc_id) AS owner FROM word WHERE win IS NOT NULL GROUP BY win
), marked AS (
  SELECT w.doc_id, w.w, w.i,
         max(CASE WHEN f.owner < w.doc_id THEN w.i END) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS last
  FROM word w LEFT JOIN first f ON f.win = w.win
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS text
  FROM marked WHERE last IS NULL OR last < i - 49 GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k USING (doc_id)
"""

MIXING = f"""
WITH doc AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {PLAIN_WORDS})) AS BIGINT) AS size,
         CAST('0x' || md5('11' || chr(10) || doc_id || chr(10) || coalesce(text, ''))[1:15] AS BIGINT) AS turn
  FROM documents
), total AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM doc GROUP BY source
), weighed AS (
  SELECT *, CASE source_no % 3 WHEN 1 THEN 5e0 WHEN 2 THEN 2e0 ELSE 1e0 END AS weight, source_size * 3e0 AS bound FROM total
), level AS (
  SELECT max(((SELECT sum(source_size) FROM total)
              - coalesce((SELECT sum(b.bound) FROM weighed b WHERE (b.bound / b.weight, b.source_no) < (a.bound / a.weight, a.source_no)), 0))
             / (SELECT sum(c.weight) FROM weighed c WHERE (c.bound / c.weight, c.source_no) >= (a.bound / a.weight, a.source_no))) AS level
  FROM weighed a
), aim AS (
  SELECT source, source_no, source_size, least(bound, level * weight) AS target FROM weighed, level
), placed AS (
  SELECT doc_id, size, source_no, source_size, target, turn,
         coalesce(sum(size) OVER (PARTITION BY source_no ORDER BY turn, doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM doc d JOIN aim a ON d.source IS NOT DISTINCT FROM a.source
), served AS (
  SELECT *, least(size, floor(target) - before - pass * source_size) AS words,
         (before + pass * source_size + least(size, floor(target) - before - pass * source_size)) / target AS finish
  FROM placed, range(3) AS r(pass) WHERE least(size, floor(target) - before - pass * source_size) > 0
), mixed AS (
  SELECT *, coalesce(sum(words) OVER (ORDER BY finish, source_no, turn, doc_id, pass
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mixed FROM served
), taken AS (
  SELECT doc_id, sum(words) AS taken, min(mixed) AS position FROM mixed GROUP BY doc_id
)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken,
       CAST(t.position AS BIGINT) AS position
FROM placed p LEFT JOIN taken t USING (doc_id)
"""

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_ROW = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_BYTES = "list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)"
# crc32 as a fold: a byte is added, then eight bits (each said by -1) are shifted out
_CRC = (f"xor(list_reduce([4294967295::BIGINT] || flatten(list_transform({_BYTES}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])),"
        " lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END),"
        " 4294967295)")
_UP = """
  SELECT level + 1, grp, idx // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {0}) WHERE n > 1 GROUP BY level, grp, idx // 16"""
MERKLE = f"""
WITH RECURSIVE doc AS (
  SELECT *, CASE WHEN {_CRC} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            ELSE text END AS said FROM documents
), leaf AS (
  SELECT doc_id, coalesce('s' || source, '-') AS grp, sha256({_ROW} || {_FIELD.format('text')}) AS leaf,
         sha256({_ROW} || {_FIELD.format('said')}) AS later FROM doc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         row_number() OVER () AS id FROM leaf
), node(level, grp, idx, digest) AS (
  SELECT 0, grp, idx, leaf FROM placed
  UNION ALL {_UP.format('node')}
), subroot AS (
  SELECT grp, max_by(digest, level) AS subroot, row_number() OVER (ORDER BY grp) - 1 AS no FROM node GROUP BY grp
), upper(level, grp, idx, digest) AS (
  SELECT 0, '', no, subroot FROM subroot
  UNION ALL {_UP.format('upper')}
), root AS (
  SELECT max_by(digest, level) AS root FROM upper
), run AS (
  SELECT *, count(*) OVER (PARTITION BY level, grp) AS width FROM (SELECT * FROM node UNION ALL SELECT * FROM upper)
), step AS (
  SELECT a.level, a.grp, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
  FROM run a JOIN run b ON a.level = b.level AND a.grp = b.grp AND a.idx // 16 = b.idx // 16
  WHERE a.width > 1 GROUP BY a.level, a.grp, a.idx
), walk(id, grp, level, idx, proof, folded) AS (
  SELECT id, grp, 0, idx, '', later FROM placed
  UNION ALL
  SELECT w.id, CASE WHEN s.l IS NULL THEN '' ELSE w.grp END, CASE WHEN s.l IS NULL THEN 0 ELSE w.level + 1 END,
         CASE WHEN s.l IS NULL THEN u.no ELSE w.idx // 16 END, w.proof || coalesce(s.l || s.r, ''),
         CASE WHEN s.l IS NULL THEN w.folded ELSE sha256(s.l || w.folded || s.r) END
  FROM walk w LEFT JOIN step s ON s.level = w.level AND s.grp = w.grp AND s.idx = w.idx
       LEFT JOIN subroot u ON u.grp = w.grp
  WHERE s.l IS NOT NULL OR w.grp != ''
), ended AS (
  SELECT id, max_by(proof, level) AS proof, max_by(folded, level) AS folded FROM walk WHERE grp = '' GROUP BY id
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed JOIN subroot USING (grp) JOIN ended USING (id), root
"""

_DRAW = "CAST('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[{0}:{1}] AS BIGINT)"
FIM = f"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         {_DRAW.format(1, 8)} AS h1, {_DRAW.format(9, 16)} AS h2, {_DRAW.format(17, 24)} AS h3, {_DRAW.format(25, 32)} AS h4
  FROM documents
), cut AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
         greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
              THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM doc
), part AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
         array_to_string(units[b + 1:], '') AS s FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form != 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form != 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM part
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": DECONTAMINATION,
    "op2_minhash": MINHASH,
    "op3_chat": CHAT,
    "op4_substrings": SUBSTRINGS,
    "op9_mixing": MIXING,
    "op12_merkle": MERKLE,
    "op13_fim": FIM,
}

"""DuckDB statements equal to the registered queries, where SQL can state them."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
BARE = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: the CTEs behind op3 over a relation ``docs`` (doc_id, text, source); the last is ``verdict``
QUALITY = rf"""
w AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS.format('text')} AS words FROM docs),
wins AS (SELECT doc_id, i, words[i:i + 4] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, line, {WORDS.format(LOWER.format('line'))} AS lw
          FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM w)),
full_lines AS (SELECT doc_id, source, line, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM lines WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
freq AS (SELECT source, norm, min(doc_id) AS first_doc FROM full_lines GROUP BY source, norm HAVING count(DISTINCT doc_id) > 5),
lost AS (SELECT doc_id, sum(n) AS n FROM full_lines l JOIN freq f
         ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm AND l.doc_id <> f.first_doc GROUP BY doc_id),
figures AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
            CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words
            FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN lost USING (doc_id)),
verdict AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
            NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (removed_words > 0
            AND (n_words - removed_words < 10 OR n_words - removed_words < 0.3 * n_words)) AS kept FROM figures)"""

ORACLE: dict[str, str] = {}

ORACLE["op1_ngram_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format('text'))} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (
        SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
        UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y USING (shingle)
          WHERE x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
          WHERE 100 * o >= 75 * (p.n + q.n - o)),
reach(node, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT b, root FROM reach JOIN links ON a = node)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON node = w.doc_id GROUP BY w.doc_id"""

ORACLE["op3_quality_rules"] = f"""
WITH docs AS (SELECT doc_id, text, source FROM documents), {QUALITY}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words FROM verdict"""

ORACLE["op4_url_filter"] = f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, {LOWER.format("regexp_extract(r, '^([^/?#]*)', 1)")} AS host,
          regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(key, host_end, path_start, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
       ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
best AS (SELECT page_id, max_by(struct_pack(key := key, verdict := k.verdict), length(key)) AS m FROM parts p JOIN rules k
         ON (p.host = host_end OR ends_with(p.host, '.' || host_end)) AND starts_with(p.path, path_start) GROUP BY page_id)
SELECT page_id, host, path, m.key AS rule, coalesce(m.verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)"""

ORACLE["op6_chat_format"] = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(k)),
steps AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '-') AS before,
          lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after,
          length(text) - length(replace(text, '\', '')) + 2 * len(regexp_extract_all(text,
          '<\|turn\|>|<\|text\|>|</s>|<s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS extra FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length(role) + length(text) + extra) AS BIGINT) AS formatted_chars,
  bool_and((before || '>' || role) IN ('->system', '->user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool',
                                       'tool>assistant', 'tool>tool')
           AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM steps GROUP BY conv_id"""

#: the CTEs behind op9 over a relation ``docs`` (doc_id, text); the last is ``hit``
CONTAMINATION = rf"""
dw AS (SELECT doc_id, {BARE.format('text')} AS words FROM docs),
iw AS (SELECT item_id, {BARE.format('text')} AS words FROM benchmark),
wins AS (SELECT DISTINCT item_id, array_to_string(words[i:i + 12], ' ') AS win, least(13, len(words)) AS n FROM (
           SELECT item_id, words, unnest(range(1, greatest(len(words) - 11, 2))) AS i FROM iw WHERE len(words) > 0)),
spots AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS win FROM (
            SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM wins) k)),
found AS (SELECT doc_id, i, s.n, item_id FROM spots s JOIN wins USING (win) WHERE s.n = wins.n),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id),
hit AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(words) AS contaminated
        FROM dw LEFT JOIN marked USING (doc_id) LEFT JOIN listed USING (doc_id))"""

ORACLE["op9_decontaminate"] = f"""
WITH docs AS (SELECT doc_id, text FROM documents), {CONTAMINATION}
SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM hit"""

#: the CTEs behind op11: crc32 byte by byte, near words by what is left of them without one character
ORACLE["op11_spelling_variants"] = f"""
WITH RECURSIVE rounds(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
       SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM rounds WHERE k < 8),
t AS (SELECT i, c AS v FROM rounds WHERE k = 8),
occ AS (SELECT doc_id, run, count(*) AS n FROM (
          SELECT doc_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
        WHERE length(run) >= 6 GROUP BY ALL),
crc(doc_id, run, n, x, pos, c) AS (
  SELECT doc_id, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), 0, CAST(4294967295 AS BIGINT) FROM occ
  UNION ALL SELECT doc_id, run, n, x, pos + 1, xor(c >> 8, v) FROM crc
  JOIN t ON t.i = xor(c & 255, CAST(('0x' || substr(x, 2 * pos + 1, 2)) AS BIGINT)) WHERE 2 * pos < length(x)),
hashed AS (SELECT run, n, xor(c, 4294967295) AS h, length(run) AS len FROM crc WHERE 2 * pos = length(x)),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % len) || substr(run, h % len + 2) ELSE run END AS word FROM hashed)
          WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT DISTINCT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
        FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
edits AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN words b ON a.rest = b.word
          UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
near AS (SELECT a, b FROM edits UNION SELECT b, a FROM edits),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-w.n, encode(b))) AS form, max(w.n) AS form_n
         FROM near JOIN words w ON w.word = b GROUP BY a),
named AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form,
          CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words LEFT JOIN best ON a = word),
path(word, root) AS (SELECT word, word FROM named UNION ALL
                     SELECT path.word, form FROM path JOIN named ON named.word = root WHERE form IS NOT NULL)
SELECT named.word, form, root, n, n_near, form_n FROM named JOIN path ON path.word = named.word
WHERE root IN (SELECT word FROM named WHERE form IS NULL)"""

ORACLE["op12_exact_dedup"] = r"""
WITH rows AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
same AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM rows JOIN same USING (t)"""

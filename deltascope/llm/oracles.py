"""SQL with the rows of operators over whole texts."""

#: Words of every text, removed where a window of 13 of them starts in a document with a smaller id.
OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM texts WHERE len(words) >= 13
), named AS (SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS phrase FROM windows),
firsts AS (SELECT phrase, min(doc_id) AS low FROM named GROUP BY phrase),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM named JOIN firsts USING (phrase), (SELECT unnest(range(13)) AS k) WHERE doc_id > low
), placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts),
kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.i) AS text
  FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""

#: Phrases of two to five words with their counts, cuts and ranks, from all stretches of words in all pieces.
OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) AS piece
  FROM documents
), spoken AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS words FROM pieces),
sizes AS (SELECT unnest(range(1, 6)) AS size),
grams AS (SELECT lang, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM spoken, sizes WHERE len(words) >= size),
counted AS (SELECT lang, array_to_string(words[i : i + size - 1], ' ') AS phrase, size, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(words)) AS n FROM spoken GROUP BY lang),
split AS (SELECT *, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM counted WHERE size > 1),
cuts AS (
  SELECT s.lang, s.phrase, s.f AS a, k, h.f AS l, t.f AS r, n,
    (1000::HUGEINT * s.f::HUGEINT * n::HUGEINT) // (h.f::HUGEINT * t.f::HUGEINT) AS score
  FROM split s JOIN totals USING (lang)
  JOIN counted h ON h.lang = s.lang AND h.phrase = array_to_string(words[:k], ' ')
  JOIN counted t ON t.lang = s.lang AND t.phrase = array_to_string(words[k + 1:], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM counted c WHERE c.lang = b.lang AND c.size > len(string_split(b.phrase, ' ')) AND c.f >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

#: Damage by CRC-32, then the least (cost, edits) for each state after each row, from the front.
OP11_SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 20 AS kind
  FROM conversations, bytes
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior, CASE
      WHEN NOT regexp_matches(text, '[^ \t\n\v\f\r]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated'
      ELSE '' END AS fault
  FROM placed
), counted AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), inserted(state, letters, paid, goes) AS (
  VALUES ('', '', 0, ''), ('', 'I', 2, 'u'), ('', 'II', 4, 'a'), ('s', '', 0, 's'), ('s', 'I', 2, 'u'), ('s', 'II', 4, 'a'),
    ('u', '', 0, 'u'), ('u', 'I', 2, 'a'), ('u', 'II', 4, 'u'), ('a', '', 0, 'a'), ('a', 'I', 2, 'u'), ('a', 'II', 4, 'a')
), edits(letter, paid) AS (VALUES ('D', 3), ('K', 0), ('R', 2)),
steps AS (
  SELECT conv_id, i, state, letters || letter AS letters, s.paid + e.paid + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS paid,
    CASE WHEN letter = 'D' THEN goes WHEN letter = 'K' THEN initial WHEN goes = 'u' THEN 'a' ELSE 'u' END AS goes
  FROM faulty, inserted s, edits e
  WHERE letter = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR (initial = 's' AND goes = '') OR initial = CASE WHEN goes = 'u' THEN 'a' ELSE 'u' END))
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS state, {'cost': 0, 'audit': ''} AS best FROM counted
  UNION ALL
  SELECT conv_id, i, goes, min({'cost': cost, 'audit': audit}) FROM (
    SELECT w.conv_id, s.i, s.goes, w.best.cost + s.paid AS cost, w.best.audit || s.letters AS audit
    FROM walk w JOIN steps s ON s.conv_id = w.conv_id AND s.i = w.i + 1 AND s.state = w.state
  ) GROUP BY conv_id, i, goes
), chosen AS (
  SELECT w.conv_id, min({'cost': best.cost + CASE state WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END, 'audit': best.audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END}) AS best
  FROM walk w JOIN counted c ON c.conv_id = w.conv_id AND c.n = w.i GROUP BY w.conv_id
), letters AS (
  SELECT conv_id, unnest(string_split(best.audit, '')) AS letter, unnest(range(1, len(best.audit) + 1)) AS p FROM chosen WHERE best.audit <> ''
), numbered AS (
  SELECT conv_id, p, letter, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), written AS (
  SELECT n.conv_id, p, o, letter, role, text, max(CASE WHEN o = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS shift
  FROM numbered n LEFT JOIN faulty f ON f.conv_id = n.conv_id AND f.i = n.i AND letter <> 'I' WHERE letter <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS lines
  FROM written GROUP BY conv_id
)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counted USING (conv_id) LEFT JOIN chosen USING (conv_id) LEFT JOIN repaired USING (conv_id)
"""

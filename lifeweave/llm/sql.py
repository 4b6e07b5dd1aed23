"""SQL equivalents, for DuckDB over the same tables."""

from __future__ import annotations

from lifeweave.functions.scalar import EDIT_MARKS
from lifeweave.llm.conversations import ME, NOTICES, OTHER
from lifeweave.llm.quality import CLOSING, TERMINAL
from lifeweave.llm.survivors import PLATFORMS

_quote = lambda s: s.replace("'", "''")

P3 = f"""
WITH photo AS (
  SELECT *, lower(regexp_replace(coalesce(title, ''), '\\.[^.]*$', '')) AS bare,
    coalesce(source, '') IN ({", ".join(f"'{p}'" for p in PLATFORMS)}) AND coalesce(ts_origin, '') = 'exif' AS is_copy,
    CAST(coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (abs(lat) < 1e-6 AND abs(lon) < 1e-6), false) AS INT)
    + CAST(coalesce(favorite, false) AS INT) + CAST(trim(coalesce(origin, '')) <> '' AND NOT starts_with(lower(trim(coalesce(origin, ''))), 'from') AS INT)
    + CAST(coalesce(regexp_matches(uri, '(::|/)Photos from \\d{{4}}/[^/]*$'), false) AS INT) AS merits
  FROM photos WHERE person IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL AND NOT isnan(ts)),
named AS (SELECT *, regexp_replace(bare, '-({"|".join(EDIT_MARKS)})$', '', 'i') AS stem FROM photo),
marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY person, kind, stem ORDER BY ts, photo_id) < 2 THEN 0 ELSE 1 END AS fresh FROM named WHERE NOT is_copy),
own AS (SELECT photo_id, person, kind, stem, ts, merits, sum(fresh) OVER (PARTITION BY person, kind, stem ORDER BY ts, photo_id ROWS UNBOUNDED PRECEDING) AS island FROM marked),
near AS (
  SELECT c.photo_id, c.person, c.kind, c.ts, c.merits, o.stem, o.island,
    row_number() OVER (PARTITION BY c.photo_id ORDER BY abs(c.ts - o.ts) NULLS LAST, o.stem, o.island) AS k
  FROM named c LEFT JOIN own o ON c.person = o.person AND c.kind = o.kind AND abs(c.ts - o.ts) < 2 WHERE c.is_copy),
lone AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY person, kind ORDER BY ts, photo_id) < 2 THEN 0 ELSE 1 END AS fresh FROM near WHERE k = 1 AND stem IS NULL),
all_rows AS (
  SELECT photo_id, person, kind, stem, island, merits FROM own
  UNION ALL SELECT photo_id, person, kind, stem, island, merits FROM near WHERE k = 1 AND stem IS NOT NULL
  UNION ALL SELECT photo_id, person, kind, chr(10), sum(fresh) OVER (PARTITION BY person, kind ORDER BY ts, photo_id ROWS UNBOUNDED PRECEDING), merits FROM lone)
SELECT min(photo_id) AS first_id, arg_min(photo_id, -merits * 1000000000000 + photo_id) AS keep_id
FROM all_rows GROUP BY person, kind, stem, island HAVING count(*) > 1
"""

_TALKS = f"""
WITH once AS (
  SELECT person, source, who, kind, ts, text, min(social_id) AS id FROM social
  WHERE kind IN ('message_in', 'message_out') AND ts IS NOT NULL AND NOT isnan(ts) AND ts <> 0 AND person IS NOT NULL AND source IS NOT NULL
    AND trim(regexp_replace(who, '[\\s\\p{{Z}}]+', ' ', 'g')) <> '' AND regexp_replace(text, '[\\s\\p{{Z}}\\p{{Cf}}\\p{{Cc}}]+', '', 'g') <> ''
    AND NOT regexp_matches(regexp_replace(lower(trim(text)), '[.!…]+$', ''), '^({_quote("|".join(f"(?:{n})" for n in NOTICES))})$')
  GROUP BY ALL),
rows AS (SELECT person, source, lower(trim(regexp_replace(who, '[\\s\\p{{Z}}]+', ' ', 'g'))) AS name, kind, ts, id FROM once),
marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY person, source, name ORDER BY ts, id) <= 28800 THEN 0 ELSE 1 END AS fresh FROM rows),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY person, source, name ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS talk FROM marked),
kept AS (SELECT person, source, name, talk, min(id) AS conv_id FROM numbered GROUP BY ALL HAVING count(DISTINCT kind) = 2)"""
P5 = _TALKS + "\nSELECT conv_id, id AS social_id FROM numbered JOIN kept USING (person, source, name, talk)"
P5_TURNS = _TALKS + f""",
turns AS (
  SELECT *, CASE WHEN kind = 'message_out' THEN '{ME}' ELSE '{OTHER}' END AS role, CAST(floor(ts / 21600) * 21600 AS BIGINT) AS block,
    CASE WHEN kind = 'message_out' THEN last_value(CASE WHEN kind = 'message_in' THEN id END IGNORE NULLS) OVER before ELSE last_value(CASE WHEN kind = 'message_out' THEN id END IGNORE NULLS) OVER before END AS reply_to
  FROM numbered WINDOW before AS (PARTITION BY person, source, name, talk ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, id AS social_id, role, reply_to, block, row_number() OVER (PARTITION BY conv_id, block ORDER BY ts, id) - 1 AS turn FROM turns JOIN kept USING (person, source, name, talk)"""

_LETTER, _BLANK = "[\\p{L}\\p{Nl}\\p{No}]", "[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]"
_CLOSE = _quote(CLOSING).replace("]", "\\]")
P10_COUNTS = f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
line AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: x <> '')) AS line FROM doc),
alike AS (SELECT doc_id, line, count(*) AS n FROM line GROUP BY ALL),
of_lines AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, sum(n) FILTER (regexp_matches(line, '[{TERMINAL}][{_CLOSE}]*$')) / sum(n) AS ended, sum(length(line) * (n - 1)) / sum(length(line) * n) AS again FROM alike GROUP BY doc_id),
sizes AS (SELECT doc_id, text, length(text) AS n_chars, regexp_extract_all(text, '{_LETTER}+(?:[''’]{_LETTER}+)*') AS words, length(regexp_replace(text, '{_BLANK}+', '', 'g')) AS solid, length(text) - length(regexp_replace(text, '\\p{{Nd}}+', '', 'g')) AS digits, length(text) - length(regexp_replace(text, '{_LETTER}+', '', 'g')) AS letters FROM doc)
SELECT doc_id, n_chars, len(words) AS n_words, coalesce(n_lines, 0) AS n_lines, round(CASE WHEN len(words) > 0 THEN list_sum(list_transform(words, lambda x: length(x))) / len(words) ELSE 0 END, 6) AS mean_word_length,
  round(CASE WHEN solid > 0 THEN (solid - letters - digits) / solid ELSE 0 END, 6) AS symbol_ratio, round(CASE WHEN solid > 0 THEN digits / solid ELSE 0 END, 6) AS digit_ratio,
  round(coalesce(ended, 0), 6) AS end_punctuation_ratio, round(coalesce(again, 0), 6) AS duplicate_line_ratio
FROM sizes LEFT JOIN of_lines USING (doc_id)
"""

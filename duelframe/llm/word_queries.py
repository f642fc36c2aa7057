"""Queries over the words and terms of ``documents``: spelling variants, lexical search and quality rules, on whole tables and whole texts."""

from __future__ import annotations

from duelframe.llm import lexical, outliers, spelling
from duelframe.llm.catalog import register, table


@register("op11_spelling_variants", r"""
WITH RECURSIVE crc(i, x, turn) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, turn + 1 FROM crc WHERE turn < 8
),
steps AS (SELECT list(x ORDER BY i) AS tab FROM crc WHERE turn = 8),
runs AS (
  SELECT doc_id::VARCHAR AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
),
counted AS (SELECT id, run, count(*) AS times FROM runs GROUP BY ALL),
coded AS (
  SELECT run, times, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS bytes
  FROM counted
),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, steps
),
slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
),
words AS (SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
),
ranked AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near
),
known AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 2 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 2 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
),
chain(word, ends, turn) AS (
  SELECT word, word, 0 FROM words
  UNION ALL SELECT c.word, k.form, c.turn + 1 FROM chain c JOIN known k ON k.word = c.ends WHERE k.form IS NOT NULL
)
SELECT k.word, k.form, c.ends AS root, k.n, k.n_near, k.form_n
FROM known k JOIN (SELECT word, arg_max(ends, turn) AS ends FROM chain GROUP BY word) c ON c.word = k.word
""")
def op11(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents"), slips=97)


@register("op12_lexical_search", r"""
WITH held AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms
  FROM documents WHERE doc_id IS NOT NULL
),
sizes AS (SELECT place, doc_id, len(terms)::BIGINT AS n FROM held WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
wanted AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)
  ) GROUP BY ALL
),
postings AS (
  SELECT place, term, count(*)::BIGINT AS tf FROM (SELECT place, unnest(terms) AS term FROM held) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), totals
),
gains AS (
  SELECT p.place, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // totals.terms)))) AS gain
  FROM postings p JOIN weights USING (term) JOIN sizes USING (place), totals
),
scores AS (
  SELECT item_id, place, sum(gain * times)::BIGINT AS score FROM wanted JOIN gains USING (term) GROUP BY ALL HAVING sum(gain * times) > 0
),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores JOIN sizes USING (place)
)
SELECT * FROM ranked WHERE rank <= 10
""")
def op12(spark, folder):
    return lexical.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op13_quality_rules")
def op13(spark, folder):
    return outliers.quality_verdicts(table(spark, folder, "documents")).drop(outliers.TEXT_KEY)

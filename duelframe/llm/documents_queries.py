"""Queries over ``documents``: the operators with production parameters, on whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.llm import cotrain, decontaminate, exact_dedup, line_dedup, minhash_dedup, substring_dedup, suffix_dedup, toxicity, wfst_tokens
from duelframe.llm.catalog import register, table

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def model_bytes(path: str = PIECES) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@register("op1_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op1(spark, folder):
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"), keep="largest")


@register("op3_sentencepiece")
def op3(spark, folder):
    return wfst_tokens.encode(table(spark, folder, "documents"), model_bytes())


@register("op4_substring_dedup")
def op4(spark, folder):
    return substring_dedup.remove_repeated_windows(table(spark, folder, "documents"), window=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op5_decontamination")
def op5(spark, folder):
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


@register("op7_suffix_array_dedup")
def op7(spark, folder):
    left = suffix_dedup.remove_repeated_bytes(table(spark, folder, "documents"), window=400)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"))


@register("op8_minhash_dedup")
def op8(spark, folder):
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def toxicity_model(spark, folder, docs):
    """The model that the query and the pipeline use: learned from labelled rows that are not held out."""
    labels = table(spark, folder, "labels").where(~held_out())
    return toxicity.learn(docs, labels)


@register("op10_toxicity")
def op10(spark, folder):
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, folder, docs))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "own_hits", "quoted_hits")


@register("op6_quality_cotraining")
def op6(spark, folder):
    scored = cotrain.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("kept"))


@register("op9_line_dedup", """
WITH lists AS (
  SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents
),
lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS place FROM lists
),
runs AS (
  SELECT doc_id, place, line, lead(line, 1) OVER doc AS line1, lead(line, 2) OVER doc AS line2, lead(place, 2) OVER doc AS ends
  FROM lines WINDOW doc AS (PARTITION BY doc_id ORDER BY place)
),
later AS (
  SELECT doc_id, place FROM (
    SELECT doc_id, place, row_number() OVER (PARTITION BY line, line1, line2 ORDER BY doc_id, place) AS turn FROM runs WHERE ends IS NOT NULL
  ) WHERE turn > 1
),
gone AS (
  SELECT DISTINCT doc_id, place + step AS place FROM later, (VALUES (0), (1), (2)) AS steps(step)
)
SELECT d.doc_id, len(d.lines)::BIGINT AS n_lines, count(g.place)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE g.place IS NULL), '')) AS kept_sha256
FROM lists d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.place = l.place
GROUP BY d.doc_id, d.lines
""")
def op9(spark, folder):
    return line_dedup.remove_repeated_runs(table(spark, folder, "documents"), min_lines=3).select("doc_id", "n_lines", "n_removed", "kept_sha256")

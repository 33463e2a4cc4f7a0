"""One query per operator, over the whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    alignment,
    bands,
    decontamination,
    html_text,
    jaccard,
    language,
    merkle,
    pieces,
    quality,
    repair,
    repeats,
    topk,
    toxicity,
)
from millrace.llm.common import held_out, stored, table, written


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    benchmark = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontamination.decontaminate(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return repeats.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    known = labels.filter(~held_out("doc_id", 5, 0))
    sample = written(toxicity.labelled_sample(docs, known, "toxic"), "labelled")
    lexicon = toxicity.learn(sample)
    marked = docs.withColumn("held_out", held_out("doc_id", 5, 0))
    return toxicity.score(marked, lexicon).drop("text")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    stored = repair.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return repair.read_documents(stored, digest=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").filter(~held_out("doc_id", 3, 1))
    one_each = labels.groupBy("doc_id").agg(F.max("quality").alias("label"))
    marked = docs.withColumn("held_out", held_out("doc_id", 3, 1))
    described = written(quality.describe(marked).drop("text"), "quality")
    weights = quality.learn(described.join(one_each, "doc_id", "left"))
    return quality.score(described, weights).drop("measures")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    marked = docs.withColumn("held_out", held_out("doc_id", 3, 1))
    known = language.prototypes(marked.filter(~F.col("held_out")))
    return language.identify(marked.select("doc_id", "text", "held_out"), *known).drop("text")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_text.extract(pages).drop("html")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    read = pieces.encode(docs, model, decoded="decoded")
    as_read = F.translate(F.coalesce("text", F.lit("")), pieces.BLANK, " ")
    return read.select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == as_read).alias("round_trip"),
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents", *columns)
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in columns]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf(*changed))
    leaves = docs.select("doc_id", "lang", merkle.leaf(*columns).alias("leaf"), tampered.alias("tampered"))
    proved = merkle.manifest(leaves, carried=["tampered"])
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    return proved.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.judge(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = alignment.align(docs, *files).select(
        "doc_id", "n_a", "n_b", "n_groups", "links", digest.alias("groups_sha256")
    )
    return alignment.score(stored(aligned, "aligned"), *files).drop("links")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_token_shards": op4_token_shards,
    "op5_quality": op5_quality,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_exact_topk": op7_exact_topk,
    "op8_language_id": op8_language_id,
    "op9_html_extraction": op9_html_extraction,
    "op10_pieces": op10_pieces,
    "op11_merkle": op11_merkle,
    "op12_quality_rules": op12_quality_rules,
    "op13_alignment": op13_alignment,
}

# SQL over the same tables, where SQL can express the result on whole tables.
ORACLES: dict[str, str] = {
    "op1_decontamination": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, words, least(10, len(words)) AS k FROM items WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(words[i + 1 : i + k], ' ') AS w
  FROM (SELECT item_id, words, k, unnest(range(len(words) - k + 1)) AS i FROM sized)),
places AS (
  SELECT doc_id, i, k, array_to_string(words[i + 1 : i + k], ' ') AS w
  FROM (
    SELECT doc_id, words, k, unnest(range(greatest(len(words) - k + 1, 0))) AS i
    FROM docs, (SELECT DISTINCT k FROM windows))),
hits AS (SELECT doc_id, i, k, item_id FROM places JOIN windows USING (k, w)),
words_hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id),
items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)""",
    "op7_exact_topk": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS parts
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.parts, v.parts) AS BIGINT) AS score
  FROM whole q JOIN whole v ON q.vec_id <> v.vec_id AND len(q.parts) = len(v.parts)
  WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10""",
    "op11_merkle": """
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang,
    sha256(concat(DOC, SRC, LNG, N, TXT)) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(concat(DOC, SRC, LNG, N1, TXT))
      ELSE sha256(concat(DOC, SRC, LNG, N, TXT)) END AS folded
  FROM (
    SELECT doc_id, lang,
      coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS DOC,
      coalesce(strlen(source) || ':' || source, '-') AS SRC,
      coalesce(strlen(lang) || ':' || lang, '-') AS LNG,
      coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS N,
      coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS N1,
      coalesce(strlen(text) || ':' || text, '-') AS TXT,
      xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
        lambda c, d: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, d)),
        4294967295), 4294967295) AS crc
    FROM documents)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
up AS (
  SELECT 0 AS level, lang, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT level + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY level, lang, pos // 2, n),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos,
    count(*) OVER () AS n
  FROM up WHERE n = 1),
over AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM over WHERE n > 1 GROUP BY level, pos // 2, n),
nodes AS (
  SELECT '=' || lang AS tree, level, pos, n, h FROM up WHERE lang IS NOT NULL
  UNION ALL SELECT '', level, pos, n, h FROM up WHERE lang IS NULL
  UNION ALL SELECT 'over', level, pos, n, h FROM over),
walk AS (
  SELECT p.doc_id, p.lang, p.leaf, p.pos AS leaf_pos, s.subroot, s.pos AS sub_pos,
    coalesce('=' || p.lang, '') AS tree, 0 AS level, p.pos, p.n, p.folded AS h, '' AS proof
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.leaf_pos, w.subroot, w.sub_pos,
    CASE WHEN w.n = 1 THEN 'over' ELSE w.tree END,
    CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END,
    CASE WHEN w.n = 1 THEN w.sub_pos ELSE w.pos // 2 END,
    CASE WHEN w.n = 1 THEN (SELECT max(n) FROM subroots) ELSE (w.n + 1) // 2 END,
    CASE WHEN w.n = 1 THEN w.h
      WHEN w.pos % 2 = 0 THEN sha256(concat(w.h, b.h)) ELSE sha256(concat(b.h, w.h)) END,
    CASE WHEN w.n = 1 THEN w.proof ELSE concat(w.proof, b.h) END
  FROM walk w LEFT JOIN nodes b
    ON b.tree = w.tree AND b.level = w.level AND b.pos = xor(w.pos, 1) AND w.n > 1
  WHERE w.n > 1 OR w.tree <> 'over')
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM walk, (SELECT h AS root FROM over WHERE n = 1) WHERE tree = 'over' AND n = 1""",
}

"""One query for each corpus operator, over its whole table, and the SQL twins there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import (
    decision_list, decontaminate, hard_negatives, mixing, ngram_join, packing, page_text, pu_quality, sharding, spelling,
    token_counts, toxicity, vector_dedup,
)
from quillgraph.llm.common import remainder
from quillgraph.sources.tables import read_table

SHARD_BYTES = 64 << 10


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs).select("doc_id", "n_tokens", "bucket", "padded_length", "batch")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    rules = decision_list.fit(docs, labels)
    return decision_list.apply_rules(docs, rules).select("doc_id", *decision_list.BASE, "base_failed", "kept")


def ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.join(docs).select("doc_id", "n_shingles", "component_id")


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.taken(docs)


def vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    weights = pu_quality.fit(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    return pu_quality.score(docs, weights).select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def byte_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, specials=("<|endoftext|>",))


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(read_table(spark, sf_dir, "pages"))


def hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, SHARD_BYTES).select("doc_id", "n_bytes", "depth", "shard", "shard_bytes")


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    run = F.col("run")
    mark = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(mark, F.length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    words = spelling.letter_runs(docs, 7).select(F.when(mark % 31 == 0, cut).otherwise(run).alias("word"))
    counts = words.filter(F.length("word") >= 7).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return spelling.variants(counts)


def hard_negative_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    stepped = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x).cast("double"))
    found = hard_negatives.mine(rows.select("vec_id", label.alias("label"), stepped.alias("vector")), F.col("vec_id") % 100 == 0)
    whole = {f"{x}_score": F.expr(f"try_cast({x}_score AS long)") for x in ("positive", "negative")}
    return found.withColumns(whole)


def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = decontaminate.contaminated(docs, items)
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


QUERIES = {
    "op1_toxicity": toxicity_scores,
    "op2_length_buckets": length_buckets,
    "op3_decision_list": quality_rules,
    "op4_ngram_join": ngram_components,
    "op5_source_mix": source_mix,
    "op6_vector_dedup": vector_duplicates,
    "op7_pu_quality": quality_scores,
    "op8_token_counts": byte_bpe_counts,
    "op9_page_text": page_articles,
    "op10_hash_shards": hash_shards,
    "op11_spelling_variants": spelling_variants,
    "op12_hard_negatives": hard_negative_sets,
    "op13_benchmark_passages": benchmark_passages,
}

ORACLES = {
    "op10_hash_shards": f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), each AS (
  SELECT d, h >> (60 - d) AS bucket, sum(n_bytes) AS shard_bytes, min(h) AS low, max(h) AS high
  FROM rows, range(0, 61) t(d) GROUP BY ALL
), leaf AS (
  SELECT r.doc_id, r.n_bytes, r.h, min(e.d) AS depth, arg_min(e.shard_bytes, e.d) AS shard_bytes
  FROM rows r JOIN each e ON e.bucket = r.h >> (60 - e.d)
  WHERE e.shard_bytes <= {SHARD_BYTES} OR e.low = e.high
  GROUP BY ALL
)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(shard_bytes AS BIGINT) AS shard_bytes
FROM leaf
""",
    "op11_spelling_variants": r"""
WITH RECURSIVE crc_table AS (  -- the reflected polynomial of crc32, eight steps a byte
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents
), lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL
), bytes AS (
  SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM lowered
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM bytes, crc_table
), made AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), gaps AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, range(0, 200) r(i) WHERE i < length(word)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), rows AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS root FROM rows
  UNION ALL SELECT c.word, r.form FROM chain c JOIN rows r ON r.word = c.root WHERE r.form IS NOT NULL
)
SELECT r.word, r.form, c.root, r.n, CAST(r.n_near AS BIGINT) AS n_near, r.form_n
FROM rows r JOIN (SELECT c.word, c.root FROM chain c JOIN rows x ON x.word = c.root WHERE x.form IS NULL) c USING (word)
""",
    "op12_hard_negatives": """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
""",
    "op13_benchmark_passages": r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS words
  FROM items, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= len(w) - least(10, len(w)) + 1
), places AS (
  SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM docs
), hits AS (
  SELECT p.row, p.i, s.size, x.item
  FROM places p JOIN (SELECT DISTINCT size FROM windows) s ON p.i + s.size - 1 <= len(p.w)
  JOIN windows x ON x.size = s.size AND x.words = array_to_string(p.w[p.i : p.i + s.size - 1], ' ')
), words AS (
  SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS place FROM hits) GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS names FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (row) LEFT JOIN named USING (row)
""",
}

"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import bpe, caps, langid, licenses, line_templates, mixing, near_dup, secrets_scan, simhash, warc
from voxloom.llm.session import bound_batches
from voxloom.llm.storage import fresh_path, materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets_scan.train(secrets_scan.labelled_samples(spark))
    return secrets_scan.digest(secrets_scan.scan(table(spark, sf_dir, "documents"), model))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "clean_text")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), near_dup.CONTRACT)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes whole-file gzip archives, normalises them, and reads the members back by the index."""
    folder = fresh_path(spark, "warc")
    records = warc.with_revisits(table(spark, sf_dir, "pages"))
    written = materialize(warc.write_archives(records, f"{folder}/whole"), "archives")
    normal = materialize(warc.normalize(written, f"{folder}/members"), "members")
    if normal.isEmpty():
        index = spark.createDataFrame([], warc.INDEX)
    else:
        index = warc.read_index(spark, f"{folder}/members")
    return warc.checked(warc.read_records(index))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also n_near: for documents whose id is divisible by 100, how many others are within the radius."""
    found = materialize(simhash.edited_likeness(table(spark, sf_dir, "documents")), "fingerprints")
    queried = found.where("doc_id % 100 = 0")
    copies = found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("fingerprint", "hit")
    near = simhash.search(found, queried).join(copies, "hit").groupBy(F.col("query").alias("fingerprint")).agg(F.sum("n").alias("n"))
    # one row a fingerprint, so rows that repeat an id stay as many as they are
    near = near.withColumnRenamed("fingerprint", "near_of")
    counted = found.join(near, (F.col("fingerprint") == F.col("near_of")) & (F.col("doc_id") % 100 == 0), "left")
    return counted.withColumn("n_near", F.col("n") - 1).drop("near_of", "n")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", F.coalesce(langid.bucket() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = bpe.encode(table(spark, sf_dir, "documents"), path)
    both = bpe.decode(tokens, path)
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_warc": op4_warc,
    "op5_license_scan": op5_license_scan,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_language_id": op7_language_id,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_mixing": op9_mixing,
    "op10_bpe": op10_bpe,
}

COMPONENTS = """
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT id AS u, id AS v FROM ids UNION SELECT r.u, s.b FROM reach r JOIN sym s ON r.v = s.a),
comp AS (SELECT u AS id, min(v) AS component_id FROM reach GROUP BY 1)"""

OP3 = rf"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))
  WHEN len(w) = 0 THEN []::VARCHAR[] ELSE [array_to_string(w, ' ')] END AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * i >= 85 * (len(x.s) + len(y.s) - i)),
ids AS (SELECT doc_id AS id FROM s),{COMPONENTS}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp ON id = doc_id"""

OP4 = """SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to, true AS digest_holds
FROM (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
  FROM (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages))"""

OP8 = f"""WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.93),
ids AS (SELECT vec_id AS id FROM embeddings),{COMPONENTS},
n AS (SELECT a AS id, count(*) AS n FROM sym GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON comp.id = vec_id LEFT JOIN n ON n.id = vec_id"""

ORACLE: dict[str, str] = {"op3_minhash_near_dedup": OP3, "op4_warc": OP4, "op8_embedding_near_dedup": OP8}

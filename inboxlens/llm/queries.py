"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from inboxlens.session import shared_dir

from . import centroids, decontaminate, exact, langid, licenses, lines, lm, minmax, phrases, pieces, pii, sharding, simhash
from .common import doc_bucket, documents


def op1_sharding(spark, sf_dir):
    docs = documents(spark, sf_dir)
    shards = shared_dir(spark, "shards")
    sharding.write_shards(docs, shards, 40, F.octet_length("text"))
    # The digest is taken from the written shards; slot is the place of a record in its shard.
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharding.read_shards(spark, shards, docs).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_exact_dedup(spark, sf_dir):
    return exact.exact_duplicates(documents(spark, sf_dir)).withColumnRenamed("sha256", "text_sha256")


def op3_decontamination(spark, sf_dir):
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_lm_scoring(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lm.score(docs, doc_bucket(F.col("doc_id"), 10) == 0)


def op9_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir)).select("doc_id", "license", "template", "containment")


def op10_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op6_pii(spark, sf_dir):
    return pii.digest(pii.spans(documents(spark, sf_dir).select("doc_id", "text")))


def op5_line_dedup(spark, sf_dir):
    return lines.dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "text", "removed_chunks", "removed_lines")


def op7_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = doc_bucket(F.col("doc_id"), 5) == 0
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op11_centroid_clustering(spark, sf_dir):
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("checked")


def op12_minhash_near_dedup(spark, sf_dir):
    return minmax.near_duplicates(documents(spark, sf_dir))


def op13_phrase_collocations(spark, sf_dir):
    return phrases.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_exact_dedup, op3_decontamination, op4_lm_scoring, op5_line_dedup, op6_pii, op7_simhash_near_dedup,
    op8_language_id, op9_license_scan, op10_sentencepiece, op11_centroid_clustering, op12_minhash_near_dedup,
    op13_phrase_collocations)}

ORACLE_SQL = {"op2_exact_dedup": exact.oracle_sql(), "op5_line_dedup": lines.oracle_sql(),
              "op9_license_scan": licenses.oracle_sql(), "op11_centroid_clustering": centroids.oracle_sql(),
              "op12_minhash_near_dedup": minmax.oracle_sql(), "op13_phrase_collocations": phrases.oracle_sql()}

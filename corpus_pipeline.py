"""Five stages that turn the raw documents table into token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result is written as Parquet and read again as
the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inboxlens.llm import decontaminate, langid, lines, pieces, simhash
from inboxlens.llm.common import doc_bucket, documents, materialize


def _row(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns as one struct: no operator's own column can then clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: null or letterless texts, and those with a narrow margin."""
    model = langid.train(docs.where(doc_bucket(F.col("doc_id"), 5) != 0))
    return langid.identify(docs.select(_row(docs), "text"), model).where(~F.col("rejected")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated chunks of lines out of all documents but the first; every document stays."""
    others = [c for c in docs.columns if c != "text"]
    out = lines.dedup_lines(docs.select(_row(docs, others), "doc_id", "text"))
    return out.select(*["text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows one stays: that of the smallest id, a null id after all others."""
    keyed = materialize(docs.select(_row(docs), F.monotonically_increasing_id().alias("key")), "near-rows")
    # Rows of one id are told apart by their texts, then by their number.
    place = F.struct(F.col("row.doc_id").isNull().alias("last"), F.col("row.doc_id").alias("id"),
                     F.xxhash64("row.text").alias("of"), F.col("key"))
    found = simhash.near_duplicates(keyed.select(place.alias("place"), F.col("row.text").alias("text")), "place")
    goes = found.where("doc_id.key != component_id.key").select("doc_id.key")
    return keyed.join(goes, "key", "left_anti").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that quote a test item, question and answer, and no others of their id."""
    # A row quotes by its text alone: rows of equal id and text go or stay together.
    rows = docs.select(_row(docs), F.struct("doc_id", F.sha2(F.col("text"), 256).alias("digest")).alias("key"))
    found = decontaminate.contaminated(rows.select("key", "row.text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key")
    goes = found.select(F.col("doc_id").alias("quoting")).distinct()
    return rows.join(goes, F.col("key") == F.col("quoting"), "left_anti").select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to its text again."""
    return pieces.encode_documents(docs).select("doc_id", "lang", "source", "token_ids", "n_tokens", "round_trip")


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("SentencePiece", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs


#: Compression, block-max search and subword encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None

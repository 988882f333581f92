"""A pipeline over documents: quality, near-duplicates, personal data, source weights, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's `docs`. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import disclosure, entropy_mix, line_crf, order_minhash, piece_codec
from millrace.llm.common import columns, free_name, remove, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled documents of `sf_dir`.

    A null or empty text has one empty line and is judged by that; very long texts are judged whole; equal texts, and so
    repeated rows and ids, go or stay together; a score of just the threshold stays; an empty table stays empty; other
    columns are kept, whatever their names."""
    found = free_name(docs, "quality_found")
    rows = line_crf.score(docs, line_crf.trained(spark, sf_dir), found=found)
    return rows.where(F.col(found)["score"] >= line_crf.THRESHOLD).select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least doc_id.

    Null, empty and wordless texts are near to equal texts only, null counting as empty; very long texts are compared
    whole; of repeated rows one stays, of equal ids that with the least digest, a null id only if there is no other; an
    empty table stays empty; other columns are kept, whatever their names."""
    return order_minhash.first_of_each_class(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with entities and disclosing terms replaced; n_chars follows the text.

    Null stays null and empty stays empty; very long texts are searched whole; equal texts, and so repeated rows and ids,
    become equal texts, and there is nothing to tie; an empty table stays empty; other columns are kept, whatever their
    names."""
    out = disclosure.sanitise(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have no words and copies at the even rate; very long texts are one document of their size; a
    null source is a source, repeated rows and ids are documents of their own, and of equal sizes the hash of the id,
    then the digest of the text decides which is taken more often; an empty table stays empty; other columns are kept,
    also those with the names of the mix's results."""
    return entropy_mix.repeated(docs, entropy_mix.n_words(F.col("text")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to: doc_id, source, ids, n_tokens, decoded_sha256.

    Null and empty texts have the end id only; very long texts are encoded whole; equal texts, and so repeated rows and
    ids, have equal ids, and there is nothing to tie; an empty table gives no rows; other columns are left out."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = piece_codec.encode_and_decode(docs.select("doc_id", "source", "text"), path)
    return rows.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_weights", source_weights),
    ("token_ids", token_ids),
]

#: SQL can't express the trained classifier, the alignment or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again, and removed when
    the next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if last:
            remove(spark, last)
        last = out
    return docs

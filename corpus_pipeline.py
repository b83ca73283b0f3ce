"""A training-data pipeline over ``documents``, one operator after the other.

Each stage is a function of the session, the documents that its predecessor kept and the
folder of the given tables. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm import language_id, line_chunks, mixing, near_dedup, piece_codec
from catchment.llm.common import id_crc
from catchment.session import materialize

LANGUAGE_SHARE = 0.34  # of a text's letters in one language: of three that share it, none is its own
SIMILARITY = 80  # percent of shared word shingles that makes near-duplicates
PIECES = "piece_bpe_32k.model"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those of which no language has a third of the letters.

    Learned from the documents of two thirds of the ids; missing languages are filled in.
    """
    model = language_id.fit_languages(docs.filter(id_crc("doc_id") % 3 != 1))
    found = language_id.with_language(docs, model)
    own = found.columns[-1]
    found = found.filter((F.col(f"{own}.lang_pred") != language_id.UNDETERMINED)
                         & (F.col(f"{own}.score") >= LANGUAGE_SHARE))
    return found.withColumn("lang", F.coalesce("lang", f"{own}.lang_pred")).select(
        *[f"`{c}`" for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut from all documents but the first; who loses every line goes."""
    left = line_chunks.dedup_lines(docs)
    emptied = (F.col(f"{left.columns[-1]}.n_removed") > 0) & (F.trim("text") == "")
    return left.filter(~F.coalesce(emptied, F.lit(False))).withColumn(
        "n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays."""
    rows = near_dedup.near_duplicates(docs, percent=SIMILARITY)
    gone = rows.filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), "text_key")
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_key"))
    # What goes grows with the corpus, hence it is not broadcast.
    return docs.hint("merge").join(gone, same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The numbers of the pieces of each text, and whether decoding them gives it again."""
    rows = piece_codec.with_pieces(docs, public_tokenizers.path(PIECES))
    return rows.select("doc_id", "lang", "source", f"{rows.columns[-1]}.*")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("mixing", mix_sources),
    ("SentencePiece", encode_pieces),
]
# The classifier, the chunks, the sets and the pieces are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialize(docs, "pipeline")
    return docs

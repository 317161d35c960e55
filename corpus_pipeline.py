"""The corpus pipeline: documents are cleaned, freed of copies, mixed and encoded, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.lineage import shared_folder
from foliospark.llm import bpe, copies, lines, mixing, quality
from foliospark.llm.queries import VOCABULARY, public_tokenizers

#: A line that so large a part of a source's documents have is its boilerplate. Of fewer documents than 1 / LINE_RATIO each
#: single line would be over that part, so such sources are left alone.
LINE_RATIO, LEAST_DOCUMENTS = 0.05, 20


def _documents(columns: list[str], text, row=None) -> list:
    """Columns of a document with a new text and its n_chars; the others from the struct ``row`` or as they are."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [(new[c] if c in new else F.col(f"`{c}`") if row is None else row[c]).alias(c) for c in columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines that fail.

    Null, empty and short texts are rejected; repeated rows get equal verdicts and all stay; an empty table stays empty. Other columns
    pass inside a struct, so that the rules' own figures replace none.
    """
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    judged = quality.judge_texts(docs.select(others, "text"), keep=["row"]).filter("kept")
    return judged.select(*_documents(docs.columns, F.col("cleaned"), F.col("row")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that too many documents of their source share.

    Null texts and documents of null sources stay as they are; repeated rows each count as a document; an empty table stays empty.
    """
    return lines.drop_boilerplate(docs, "source", "text", LINE_RATIO, LEAST_DOCUMENTS).select(*_documents(docs.columns, F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies.

    Null ids come last; null and empty texts are copies of each other; of rows that repeat an id and text one stays; an empty table
    stays empty.
    """
    return copies.without_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says.

    Null texts have no words; a null source is a source; rows that repeat an id come equally often; an empty table stays empty.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and the digests that show them lossless.

    A null text is an empty one, without tokens; rows are independent, so repeated ones agree; an empty table stays empty.
    """
    return bpe.encode_texts(docs.select("doc_id", "source", "lang", "text"), VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id", "source", "lang"])


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("mixing", mix_sources), ("byte-level bpe", encode)]
#: SQL has no SimHash of shingles and no BPE; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    shared = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        at = f"{shared}/pipeline-{uuid.uuid4().hex}/{i}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs

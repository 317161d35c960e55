"""The thin queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_folder
from . import bpe, chaining, lines, matroska, mixing, perspectives, quality, rollups, secrets, simhash
from .common import cut, read

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_texts(read(spark, sf_dir, "documents"), keep=["doc_id"], with_media=False)


def op2_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.replay(read(spark, sf_dir, "documents"), rollups.TokenRollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(read(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id"], with_ids=False)


def op7_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_texts(read(spark, sf_dir, "documents"), keep=["doc_id"], with_text=False)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_texts(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perspectives.rotate(read(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.withColumn("mask", spans)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The texts are read twice, to count lines and to drop them; taking them out of the pages costs far more than storing them.
    pages = cut(read(spark, sf_dir, "pages").select("page_id", lines.host_of(F.col("url")).alias("host"), lines.page_text(F.col("html")).alias("text")))
    return lines.drop_boilerplate(pages, "host", "text")


QUERIES = {f.__name__: f for f in (op1_matroska, op2_fuzzy_passages, op3_mixing, op4_token_rollup, op5_simhash, op6_byte_bpe, op7_line_first, op8_secrets, op9_perspectives, op10_line_dedup)}
ORACLE_SQL = {"op3_mixing": mixing.SQL, "op4_token_rollup": rollups.SQL, "op7_line_first": quality.SQL, "op9_perspectives": perspectives.SQL, "op10_line_dedup": lines.SQL}

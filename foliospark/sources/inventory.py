"""Inventories of JSON lines: strict decoding by built-in functions, errors as rows with a line number and no content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.canonical import is_strict_json
from ..functions.naming import stripped
from ..lineage import cut
from ..operators import constraints as C

FILE_FIELDS = {"source_path": "string", "filename": "string", "size_bytes": "bigint", "sha256": "string"}
ACCOUNT_FIELDS = ("account_id", "company_id", "company_name", "division_id", "division_name", "period", "account_code", "account_name", "status")
ATTACHMENT_FIELDS = ("document_id", "account_id")


@dataclass
class Inventory:
    """Accounts, attachments and violations as DataFrames, and the digest of the file's bytes."""

    accounts: DataFrame
    attachments: DataFrame
    violations: DataFrame
    sha256: str


def lines(spark: SparkSession, path: str) -> DataFrame:
    r"""(line_no, line) of one file, as bytes that only \n ends.

    The file is read in splits. A line's number is its place in its split and the lines of the splits before, which are counted first:
    one short row a split.
    """
    block = F.col("_metadata.file_block_start").alias("block")
    rows = spark.read.option("lineSep", "\n").text(path).select(block, F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))
    counts = rows.groupBy("block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = cut(counts.withColumn("before", before))
    return rows.join(F.broadcast(blocks) if blocks.count() <= 20_000 else blocks, "block").select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def digest_of(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, streamed by the JVM from whatever store holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def _text(record: Column, path: str) -> Column:
    """A field's text if the field is a string there."""
    field = F.try_variant_get(record, path, "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(record, path, "string"))


def _count(record: Column, path: str) -> Column:
    """A field's number if the field is a whole number there; true, 1.5 and "7" are none."""
    field = F.try_variant_get(record, path, "variant")
    return F.when(F.schema_of_variant(field) == "BIGINT", F.try_variant_get(record, path, "bigint"))


def _file(record: Column, at: str) -> Column:
    return F.struct(*((_count if kind == "bigint" else _text)(record, f"{at}.{name}").alias(name) for name, kind in FILE_FIELDS.items()))


def parse(found: DataFrame) -> DataFrame:
    """One row a line that is not blank: record_type, all fields and ``diagnosis`` (null: a valid record)."""
    text = F.when(F.is_valid_utf8(F.col("line").cast("string")), F.col("line").cast("string"))
    rows = found.filter(F.length(F.regexp_replace(F.decode("line", "ISO-8859-1"), r"[ \t\r\x0b\x0c]", "")) > 0).select("line_no", text.alias("text"))
    record = F.when(is_strict_json(F.col("text")), F.try_parse_json("text"))
    rows = rows.withColumn("record", record)
    kind = _text(F.col("record"), "$.record_type")
    cover = F.try_variant_get("record", "$.cover", "variant")
    has_cover = cover.isNotNull() & ~F.coalesce(F.is_variant_null(cover), F.lit(True))
    rows = rows.select(
        "line_no", "text", "record", kind.alias("record_type"),
        *(_text(F.col("record"), f"$.{n}").alias(n) for n in dict.fromkeys((*ACCOUNT_FIELDS, *ATTACHMENT_FIELDS))),
        F.when(has_cover, _file(F.col("record"), "$.cover")).alias("cover"), has_cover.alias("has_cover"), _file(F.col("record"), "$").alias("file"),
    ).select("*", *(F.col(f"file.{n}").alias(n) for n in FILE_FIELDS))
    keys = lambda text, names: F.coalesce(F.forall(F.json_object_keys(text), lambda k: k.isin(*names)), F.lit(False))
    cover_text = F.get_json_object("text", "$.cover")
    account_ok = keys(F.col("text"), ("record_type", "cover", *ACCOUNT_FIELDS)) & (~F.col("has_cover") | keys(cover_text, tuple(FILE_FIELDS)))
    for rule in C.account_rules().values():
        account_ok = account_ok & rule
    attachment_ok = keys(F.col("text"), ("record_type", *ATTACHMENT_FIELDS, *FILE_FIELDS))
    for rule in C.attachment_rules().values():
        attachment_ok = attachment_ok & rule
    ok = F.when(F.col("record_type") == "account", account_ok).otherwise(attachment_ok)
    wrong = F.when(F.col("record").isNull(), "invalid_json").otherwise(C.diagnosis(F.col("record_type"), F.col("status"), F.col("has_cover"), ok))
    return rows.withColumn("diagnosis", wrong)


def load(spark: SparkSession, path: str) -> Inventory:
    """The inventory with all violations: of lines, then repeated keys, then attachments without an account."""
    digest = digest_of(spark, path)
    # Everything later on reads these rows, many times in one plan.
    rows = cut(parse(lines(spark, path)))
    good = rows.filter("diagnosis IS NULL")
    trimmed = lambda n: stripped(F.col(n)).alias(n)
    file = lambda ref: F.struct(*(F.lower(f"{ref}.{n}").alias(n) if n == "sha256" else F.col(f"{ref}.{n}").alias(n) if n == "size_bytes" else stripped(F.col(f"{ref}.{n}")).alias(n) for n in FILE_FIELDS))
    accounts = good.filter("record_type = 'account'").select("line_no", *(trimmed(n) for n in ACCOUNT_FIELDS), F.when(F.col("has_cover"), file("cover")).alias("cover"))
    attachments = good.filter("record_type = 'attachment'").select("line_no", *(trimmed(n) for n in ATTACHMENT_FIELDS), file("file").alias("f")).select("line_no", *ATTACHMENT_FIELDS, "f.*")
    broken = rows.filter("diagnosis IS NOT NULL").select(F.lit(1).alias("priority"), "line_no", F.col("diagnosis").alias("rule"))
    twice = lambda t, key, rule: t.join(C.duplicates(t, key).select(key), key, "left_semi").groupBy().agg(F.min("line_no").alias("line_no")).filter("line_no IS NOT NULL").select(F.lit(2).alias("priority"), "line_no", F.lit(rule).alias("rule"))
    lost = C.orphans(attachments, accounts, "account_id").select(F.lit(3).alias("priority"), "line_no", F.lit("orphan_attachment").alias("rule"))
    empty = rows.groupBy().agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(1).alias("priority"), F.lit(0).alias("line_no"), F.lit("no_records").alias("rule"))
    violations = broken.union(empty).union(twice(accounts, "account_id", "duplicate_account_id")).union(twice(attachments, "document_id", "duplicate_document_id")).union(lost)
    return Inventory(accounts.drop("line_no"), attachments.drop("line_no"), violations, digest)

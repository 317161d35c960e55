"""The inventory's tables as projections of the star schema at hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account for each order: its company is the customer's nation, its division their market segment."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, customers.c_nationkey == nations.n_nationkey)
    done, key = F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")
    cover = F.struct(
        F.concat(F.lit("covers/"), key, F.lit(".pdf")).alias("source_path"), F.lit("cover.pdf").alias("filename"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"), F.sha2(key, 256).alias("sha256"),
    )
    return joined.select(
        key.alias("account_id"), F.col("c_nationkey").cast("string").alias("company_id"), F.col("n_name").alias("company_name"),
        F.col("c_mktsegment").alias("division_id"), F.col("c_mktsegment").alias("division_name"), F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.col("c_custkey").cast("string").alias("account_code"), F.col("c_name").alias("account_name"),
        F.when(done, "completed").otherwise("pending").alias("status"), F.when(done, cover).alias("cover"),
    )


def attachments(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame] = lambda lines: lines) -> DataFrame:
    """An attachment for each (order, line number), named after the part. ``keep`` may store the few columns that it is made of."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("partkey"), F.sum("l_quantity").alias("quantity"))
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    key = F.col("l_orderkey").cast("string").alias("account_id")
    document = F.concat("account_id", F.lit("-"), F.col("l_linenumber").cast("string"))
    return keep(lines.join(parts, lines.partkey == parts.p_partkey).select(key, "l_linenumber", "p_name", "quantity")).select(
        document.alias("document_id"), "account_id", F.concat(F.lit("attachments/"), document, F.lit(".pdf")).alias("source_path"),
        F.concat("p_name", F.lit(".pdf")).alias("filename"), (F.floor("quantity").cast("long") * 1024).alias("size_bytes"), F.sha2(document, 256).alias("sha256"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the journal of a job, numbered in order of time."""
    kinds = {"signup": "START", "view": "ARCHIVE_VERIFIED", "purchase": "COMPLETE", "click": "MASTER_VERIFIED"}
    kind = F.lit("UNKNOWN")
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job"), "ts", "event_id", kind.alias("event"),
        F.pmod("event_id", F.lit(7)).alias("archive_index"), F.floor(F.abs("value") * 100).cast("long").alias("size_bytes"),
    )


#: The same projections in DuckDB's SQL.
SQL = r"""
accounts AS (SELECT CAST(o_orderkey AS VARCHAR) AS account_id, CAST(c_nationkey AS VARCHAR) AS company_id, n_name AS company_name, c_mktsegment AS division_id, c_mktsegment AS division_name,
    strftime(o_orderdate, '%Y-%m') AS period, CAST(c_custkey AS VARCHAR) AS account_code, c_name AS account_name, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'pending' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) END AS cover_bytes
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
attachments AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS document_id, CAST(l_orderkey AS VARCHAR) AS account_id, p_name || '.pdf' AS filename, CAST(floor(quantity) AS BIGINT) * 1024 AS size_bytes
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2) JOIN part ON partkey = p_partkey),
members AS (SELECT company_id, division_id, period, account_id, account_code, account_name, NULL AS document_id, 'cover' AS kind, 'Capa' AS category, 'cover.pdf' AS filename, cover_bytes AS size_bytes,
    'covers/' || account_id || '.pdf' AS source_path, sha256(account_id) AS sha256 FROM accounts WHERE cover_bytes IS NOT NULL
  UNION ALL SELECT company_id, division_id, period, a.account_id, account_code, account_name, t.document_id, 'attachment', 'Anexos', t.filename, t.size_bytes, 'attachments/' || t.document_id || '.pdf', sha256(t.document_id)
  FROM attachments t JOIN accounts a ON a.account_id = t.account_id),
journal AS (SELECT CAST(user_id AS VARCHAR) AS job, ts, event_id, CASE event_type WHEN 'signup' THEN 'START' WHEN 'view' THEN 'ARCHIVE_VERIFIED' WHEN 'purchase' THEN 'COMPLETE' WHEN 'click' THEN 'MASTER_VERIFIED' ELSE 'UNKNOWN' END AS event,
    event_id % 7 AS archive_index, CAST(floor(abs(value) * 100) AS BIGINT) AS size_bytes FROM events)
"""

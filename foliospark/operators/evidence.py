"""Content digests and their reconciliation with what records declare; set and order comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def evidence(content: Column) -> dict[str, Column]:
    """Size and SHA-256 of a text's or binary's bytes."""
    return {"size_bytes": F.octet_length(content).cast("long"), "sha256": F.sha2(content.cast("binary"), 256)}


def content_mismatches(declared: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Declared files that are missing or differ in size or digest from the observed; digests are compared in lower case."""
    seen = observed.select(key, F.col("size_bytes").alias("seen_bytes"), F.col("sha256").alias("seen_sha256"))
    issue = F.when(F.col("seen_bytes").isNull(), "missing").when(F.col("seen_bytes") != F.col("size_bytes"), "size").when(F.col("seen_sha256") != F.lower("sha256"), "sha256")
    return declared.join(seen, key, "left").withColumn("issue", issue).filter("issue IS NOT NULL").select(key, "size_bytes", "seen_bytes", "issue")


def duplicate_content(files: DataFrame, key: str) -> DataFrame:
    """Digests that several files have, with the first and the number of files."""
    return files.groupBy("sha256", "size_bytes").agg(F.count("*").alias("n_files"), F.min(key).alias("first_key")).filter("n_files > 1")


def reconcile(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_expected, n_observed, verdict): missing, unknown, repeated or ok, null keys being equal to each other.

    Both sides are counted by key before they meet, so that no key is joined many to many.
    """
    def counted(side: DataFrame, n: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.count("*").alias(n))

    a, b = counted(expected, "n_expected").alias("a"), counted(observed, "n_observed").alias("b")
    on = reduce(lambda p, q: p & q, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    n, m = F.coalesce("n_expected", F.lit(0)), F.coalesce("n_observed", F.lit(0))
    verdict = F.when(m == 0, "missing").when(n == 0, "unknown").when(m > n, "repeated").when(m < n, "missing").otherwise("ok")
    chosen = [F.when(F.col("n_expected").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    return a.join(b, on, "full_outer").select(*chosen, n.cast("long").alias("n_expected"), m.cast("long").alias("n_observed"), verdict.alias("verdict"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, marked by side; none if the two cover each other exactly."""
    only = lambda x, y, side: x.exceptAll(y).withColumn("side", F.lit(side))
    return only(a, b, "left").union(only(b, a, "right"))


def checkpoints_against_plan(plan: DataFrame, recorded: DataFrame, present: DataFrame, index: str = "archive_index") -> DataFrame:
    """(index, action) of a resumed build for each planned archive and each one recorded or present.

    reuse: recorded and present alike; adopt: present but not recorded; build: neither; missing: recorded but gone;
    diverging: recorded otherwise than present; unknown: not in the plan.
    """
    planned = plan.select(index, F.lit(True).alias("planned"))
    logged = recorded.select(index, F.col("sha256").alias("logged"), F.col("size_bytes").alias("logged_bytes"))
    there = present.select(index, F.col("sha256").alias("found"), F.col("size_bytes").alias("found_bytes"))
    same = (F.col("logged") == F.col("found")) & (F.col("logged_bytes") == F.col("found_bytes"))
    action = (
        F.when(F.col("planned").isNull(), "unknown")
        .when(F.col("logged").isNull() & F.col("found").isNull(), "build")
        .when(F.col("found").isNull(), "missing")
        .when(F.col("logged").isNull(), "adopt")
        .when(same, "reuse")
        .otherwise("diverging")
    )
    return planned.join(logged, index, "full_outer").join(there, index, "full_outer").select(index, action.alias("action"), F.coalesce("found_bytes", F.lit(0)).alias("found_bytes"))


def positional_differences(ordered: DataFrame, listed: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """Positions at which two ordered lists differ, or that only one of them has."""
    left = ordered.select(position, F.struct(*columns).alias("a"))
    right = listed.select(position, F.struct(*columns).alias("b"))
    return left.join(right, position, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(position)


def listing_differs(names: Column, manifest_names: Column, manifest: str) -> Column:
    """Whether an archive's names, in order, are other than the manifest's and then the manifest itself."""
    return ~names.eqNullSafe(F.concat(manifest_names, F.array(F.lit(manifest))))


def name_collisions(entries: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Scopes in which fewer distinct keys than names are found: grouped by key first, so no set is gathered."""
    by_key = entries.groupBy(*scope, key).agg(F.count("*").alias("n"))
    return by_key.groupBy(*scope).agg(F.sum("n").alias("n_names"), F.count("*").alias("n_keys")).filter("n_names > n_keys")

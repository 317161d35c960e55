"""Checks of an inventory's records as rows of violations, never as exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.naming import stripped

#: Lengths that fields may have, after trimming. Fixed values.
IDENTIFIER, SOURCE_PATH, FILENAME = 128, 2048, 255
PERIOD, SHA256, LOWER_SHA256 = r"^[0-9]{4}-(0[1-9]|1[0-2])$", "^[0-9a-fA-F]{64}$", "^[0-9a-f]{64}$"
STATUSES = ("completed", "pending")
CATEGORIES = {"cover": "Capa", "attachment": "Anexos"}


def text_within(value: Column, most: int) -> Column:
    """A text of 1 to ``most`` characters, white space at its ends not counted."""
    return F.coalesce(F.length(stripped(value)).between(1, most), F.lit(False))


def is_digest(value: Column, lower_only: bool = False) -> Column:
    return F.coalesce(value.rlike(LOWER_SHA256 if lower_only else SHA256), F.lit(False))


def is_count(value: Column) -> Column:
    """A number, and not below zero."""
    return F.coalesce(value >= 0, F.lit(False))


def file_rules(ref: str = "") -> dict[str, Column]:
    at = lambda name: F.col(f"{ref}{name}")
    return {
        "source_path": text_within(at("source_path"), SOURCE_PATH),
        "filename": text_within(at("filename"), FILENAME),
        "size_bytes": is_count(at("size_bytes")),
        "sha256": is_digest(at("sha256")),
    }


def account_rules() -> dict[str, Column]:
    """Each field's rule for an account; a cover's fields only where there is one."""
    named = {n: text_within(F.col(n), IDENTIFIER) for n in ("account_id", "company_id", "division_id", "account_code")}
    named |= {n: text_within(F.col(n), FILENAME) for n in ("company_name", "division_name", "account_name")}
    named |= {"period": F.coalesce(stripped(F.col("period")).rlike(PERIOD), F.lit(False)), "status": F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))}
    return named | {f"cover.{n}": F.col("cover").isNull() | rule for n, rule in file_rules("cover.").items()}


def attachment_rules() -> dict[str, Column]:
    return {n: text_within(F.col(n), IDENTIFIER) for n in ("document_id", "account_id")} | file_rules()


def field_violations(records: DataFrame, rules: dict[str, Column], key: Column) -> DataFrame:
    """(rule, key): one row for each field that breaks its rule, in one pass over the records."""
    broken = F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items()))
    return records.select(F.explode(F.array_compact(broken)).alias("rule"), key.cast("string").alias("key"))


def cover_violations(accounts: DataFrame) -> DataFrame:
    """Completed accounts without a cover and pending ones with one."""
    rule = F.when((F.col("status") == "completed") & F.col("cover").isNull(), "completed_without_cover").when((F.col("status") == "pending") & F.col("cover").isNotNull(), "pending_with_cover")
    return accounts.select(rule.alias("rule"), F.col("account_id").alias("key")).filter("rule IS NOT NULL")


def duplicates(records: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one record has, and how many; counted on the map side first."""
    return records.groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def dependency_violations(records: DataFrame, determinant: list[str], dependent: str) -> DataFrame:
    """Keys with more than one value of what they should determine. min and max tell that without counting distinct values."""
    return records.groupBy(*determinant).agg(F.min(dependent).alias("least"), F.max(dependent).alias("greatest")).filter(~F.col("least").eqNullSafe(F.col("greatest")))


def diagnosis(record_type: Column, status: Column, has_cover: Column, fields_ok: Column) -> Column:
    """What is wrong with a record, told without its content; null if nothing is."""
    return (
        F.when(~F.coalesce(record_type.isin("account", "attachment"), F.lit(False)), "unknown_record_type")
        .when((record_type == "account") & ~F.coalesce(status.isin(*STATUSES), F.lit(False)), "invalid_status")
        .when((record_type == "account") & (status == "completed") & ~has_cover, "completed_without_cover")
        .when((record_type == "account") & (status == "pending") & has_cover, "pending_with_cover")
        .when(~F.coalesce(fields_ok, F.lit(False)), "invalid_record")
    )


def first_violation(violations: DataFrame, scope: list[str], order: str, what: str) -> DataFrame:
    """The violation with the smallest ``order`` of each scope (of all rows for an empty one): a minimum, not a sort."""
    return violations.groupBy(*scope).agg(F.min(F.struct(order, what)).alias("first")).select(*scope, f"first.{order}", f"first.{what}")


def path_violation(path: Column) -> Column:
    """Why a relative source path is refused; null for one that is fine."""
    parts = F.split(path, "/")
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(path.contains("\x00"), "nul")
        .when(path.contains("\\"), "backslash")
        .when(path.contains(":"), "colon")
        .when(path.startswith("/"), "absolute")
        .when(F.exists(parts, lambda p: p.isin("", ".", "..")), "segment")
    )


def is_canonical_member(path: Column, safe: Column | None = None) -> Column:
    """A relative path of four parts without dots, backslashes and colons; ``safe`` tells if each part is a safe name."""
    parts = F.split(path, "/")
    shaped = (F.size(parts) == 4) & F.forall(parts, lambda p: ~p.isin("", ".", "..")) & ~path.contains("\\") & ~path.contains(":")
    return F.coalesce(shaped if safe is None else shaped & safe, F.lit(False))


def has_just_the_keys(record: Column, keys: list[str]) -> Column:
    """A JSON object with these keys and no others."""
    return F.coalesce(F.array_sort(F.json_object_keys(record)) == F.array(*(F.lit(k) for k in sorted(keys))), F.lit(False))

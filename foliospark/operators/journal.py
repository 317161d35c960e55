"""A build's journal: the rules of its sequence, the state it amounts to, and what may be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENTS = ("START", "ARCHIVE_VERIFIED", "MASTER_VERIFIED", "COMPLETE")


def sequence_violations(events: DataFrame, scope: str, order: list[str], archive_count: int, master_expected: bool) -> DataFrame:
    """(scope, order columns, event, rule) for events that break the sequence.

    START comes first and once; indices are within the plan and given once; a master comes after all archives, where
    one is expected, and once; COMPLETE comes after everything it needs; nothing comes after it; no other events.
    """
    by = Window.partitionBy(scope).orderBy(*order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    is_ = lambda name: (F.col("event") == name).cast("int")
    first_index = F.row_number().over(Window.partitionBy(scope, "event", "archive_index").orderBy(*order)) == 1
    in_range = F.col("archive_index").between(0, archive_count - 1)
    told = events.withColumn("__new", (F.col("event") == "ARCHIVE_VERIFIED") & first_index & F.coalesce(in_range, F.lit(False)))
    seen = {n: F.coalesce(F.sum(is_(e)).over(before), F.lit(0)) for n, e in (("starts", "START"), ("masters", "MASTER_VERIFIED"), ("completes", "COMPLETE"))}
    told = told.withColumns({"__place": F.row_number().over(by), "__archives": F.coalesce(F.sum(F.col("__new").cast("int")).over(before), F.lit(0)), **{f"__{n}": c for n, c in seen.items()}})
    event, missing = F.col("event"), F.col("__archives") < archive_count
    rule = (
        F.when((F.col("__place") == 1) & (event != "START"), "no_start")
        .when(F.col("__completes") > 0, "after_complete")
        .when((F.col("__place") > 1) & (event == "START"), "second_start")
        .when((event == "ARCHIVE_VERIFIED") & ~F.coalesce(in_range, F.lit(False)), "index_range")
        .when((event == "ARCHIVE_VERIFIED") & ~F.col("__new"), "index_repeated")
        .when((event == "ARCHIVE_VERIFIED") & (F.col("__masters") > 0), "archive_after_master")
        .when((event == "MASTER_VERIFIED") & (F.lit(not master_expected) | (F.col("__masters") > 0) | missing), "master")
        .when((event == "COMPLETE") & (missing | (F.lit(master_expected) & (F.col("__masters") == 0))), "premature_complete")
        .when(~event.isin(*EVENTS), "unknown_event")
    )
    return told.select(scope, *order, "event", rule.alias("rule")).filter("rule IS NOT NULL")


def state(events: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """One row a journal: counts of events and archives, bytes of archives, and its first and last event. No window: sums and extremes, combined on the map side."""
    at = F.struct(*order, "event")
    is_ = lambda name: F.sum((F.col("event") == name).cast("long"))
    return events.groupBy(scope).agg(
        F.count("*").alias("n_events"), is_("ARCHIVE_VERIFIED").alias("n_checkpoints"), is_("MASTER_VERIFIED").alias("n_masters"), is_("COMPLETE").alias("n_completes"),
        F.coalesce(F.sum(F.when(F.col("event") == "ARCHIVE_VERIFIED", F.col("size_bytes"))), F.lit(0)).alias("checkpoint_bytes"),
        F.min(at)["event"].alias("first_event"), F.max(at)["event"].alias("last_event"),
    )


def resume_conflicts(recorded: DataFrame, planned: DataFrame) -> DataFrame:
    """(field) for each of two one-row tables' common columns that differ: plan and inventory digests, counts, master."""
    fields = [c for c in planned.columns if c in recorded.columns]
    one = F.lit(1).alias("one")
    both = recorded.select(one, *(F.col(c).alias(f"r_{c}") for c in fields)).join(planned.select(one, *(F.col(c).alias(f"p_{c}") for c in fields)), "one")
    wrong = F.array_compact(F.array(*(F.when(~F.col(f"r_{c}").eqNullSafe(F.col(f"p_{c}")), F.lit(c)) for c in fields)))
    return both.select(F.explode(wrong).alias("field"))


def remaining_bytes(required: int, reused: int) -> int:
    """What a resumed build still needs."""
    return max(0, required - reused)

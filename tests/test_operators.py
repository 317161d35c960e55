"""Operators with cases that the tables lack."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import constraints as C
from foliospark.operators import evidence as E
from foliospark.operators import journal as J
from foliospark.operators import planning as P
from foliospark.operators.naming import account_folders, unique_names


def greedy(names):
    """Names tried one after another against all given out before."""
    used, out = set(), []
    for name in names:
        stem, dot, end = name.rpartition(".")
        stem, suffix = (stem, dot + end) if stem and end else (name, "")
        n, found = 1, name
        while found.casefold() in used:
            n += 1
            found = f"{stem} ({n}){suffix}"
        used.add(found.casefold())
        out.append(found)
    return out


@pytest.mark.parametrize("ascii_only", [True, False])
def test_names_are_unique_as_if_tried_one_by_one(spark, ascii_only):
    rng = random.Random(3)
    pool = ["a.pdf", "A.PDF", "a (2).pdf", "a (3).pdf", "a (2) (2).pdf", "b", "b (2)", ".pdf", "c (2).pdf"]
    for _ in range(4):
        names = [rng.choice(pool) for _ in range(40)]
        rows = spark.createDataFrame([("s", i, n) for i, n in enumerate(names)], "scope string, at int, name string")
        found = {r["at"]: r["out"] for r in unique_names(rows, ["scope"], ["at"], "name", "out", ascii_only).collect()}
        assert [found[i] for i in range(40)] == greedy(names)


def test_the_case_that_ranks_get_wrong(spark):
    rows = spark.createDataFrame([(1, "a.pdf"), (2, "a (2).pdf"), (3, "a.pdf")], "at int, name string")
    assert sorted(r["out"] for r in unique_names(rows, [], ["at"], "name", "out").collect()) == ["a (2).pdf", "a (3).pdf", "a.pdf"]


def test_folders_give_up_room_for_numbers(spark):
    rows = [("c", "d", "2026-01", str(i), "1", name, 8) for i, name in enumerate(["Cash/Reserve", "Cash?Reserve", "Cash_Reserve", "Other", "💼💼💼💼💼", "💼💼💼💼💼"])]
    found = account_folders(spark.createDataFrame(rows, "company_id string, division_id string, period string, account_id string, account_code string, account_name string, name_units long"))
    assert [r.folder for r in found.orderBy("account_id").collect()] == ["1 - Cash_Res", "1 - Cash (2)", "1 - Cash (3)", "1 - Other", "1 - 💼💼💼💼", "1 - 💼💼 (2)"]


def test_reconciliation_counts_null_keys_as_equal(spark):
    a = spark.createDataFrame([("x", None), ("x", "1"), ("y", "2"), ("z", "3")], "k string, d string")
    b = spark.createDataFrame([("x", None), ("x", "1"), ("x", "1"), ("w", None), ("z", "3")], "k string, d string")
    found = {(r.k, r.d): r.verdict for r in E.reconcile(a, b, ["k", "d"]).collect()}
    assert found == {("x", None): "ok", ("x", "1"): "repeated", ("y", "2"): "missing", ("w", None): "unknown", ("z", "3"): "ok"}


def test_content_mismatches(spark):
    declared = spark.createDataFrame([("a", 1, "AB"), ("b", 2, "cd"), ("c", 3, "ef"), ("d", 4, "gh")], "k string, size_bytes long, sha256 string")
    seen = spark.createDataFrame([("a", 1, "ab"), ("b", 9, "cd"), ("c", 3, "xx")], "k string, size_bytes long, sha256 string")
    assert {r.k: r.issue for r in E.content_mismatches(declared, seen, "k").collect()} == {"b": "size", "c": "sha256", "d": "missing"}


def test_checkpoints(spark):
    plan = spark.createDataFrame([(i,) for i in range(5)], "archive_index long")
    kind = "archive_index long, sha256 string, size_bytes long"
    logged = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "c", 3)], kind)
    found = spark.createDataFrame([(0, "a", 1), (1, "x", 2), (3, "d", 4), (9, "e", 5)], kind)
    assert {r.archive_index: r.action for r in E.checkpoints_against_plan(plan, logged, found).collect()} == {0: "reuse", 1: "diverging", 2: "missing", 3: "adopt", 4: "build", 9: "unknown"}


GOOD = ["START", 0, 1, "MASTER_VERIFIED", "COMPLETE"]


def journal(spark, events):
    rows = [("j", i, "ARCHIVE_VERIFIED" if isinstance(e, int) else e, e if isinstance(e, int) else None) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "job string, at long, event string, archive_index long")


@pytest.mark.parametrize(
    ("events", "rules"),
    [
        (GOOD, []),
        (GOOD[1:], ["no_start"]),
        (["START", *GOOD], ["second_start"]),
        ([*GOOD, 1], ["after_complete"]),
        (["START", 0, "MASTER_VERIFIED"], ["master"]),
        (["START", 0, 0], ["index_repeated"]),
        (["START", 5], ["index_range"]),
        (["START", 0, 1, "COMPLETE"], ["premature_complete"]),
        (["START", 0, 1, "MASTER_VERIFIED", "MASTER_VERIFIED"], ["master"]),
        (["START", "OTHER"], ["unknown_event"]),
    ],
)
def test_journal_sequences(spark, events, rules):
    assert [r.rule for r in J.sequence_violations(journal(spark, events), "job", ["at"], 2, True).orderBy("at").collect()] == rules


def test_remaining_bytes():
    assert (J.remaining_bytes(10, 3), J.remaining_bytes(3, 10)) == (7, 0)


def members(spark, rows):
    return spark.createDataFrame([(0, p, p) for p in rows], "archive_index long, member_path string, extraction_path string")


def test_preflight(spark):
    pairs = spark.createDataFrame([("c", "d", "x.zip", 1, 100), ("c", "e", "X.ZIP", 1, 100)], "company_id string, division_id string, filename string, member_count long, bound_bytes long")
    planned = members(spark, ["2026-01/a/Capa/x.pdf", "2026-01/A/Capa/X.pdf", "2026-01/a /Capa/y", "2026-01/b/Anexos/" + "n" * 200])
    found = {(r.rule, r.n) for r in P.preflight_violations(planned, pairs, P.Target("/o"), 199).groupBy("rule").agg(F.count("*").alias("n")).collect()}
    assert found == {("member_name", 1), ("member_collision", 1), ("extraction_collision", 1), ("archive_collision", 1), ("path_limit", 1), ("free_space", 1)}


@pytest.mark.parametrize("limit", [0, 186, True])
def test_targets_out_of_range(limit):
    with pytest.raises(ValueError):
        P.check_target(P.Target("/o", limit), 1)


def test_violations_come_with_rule_and_key(spark):
    rows = spark.createDataFrame([("a", " x ", 1), ("b", "  ", -1), (None, None, None)], "key string, name string, n long")
    found = C.field_violations(rows, {"name": C.text_within(F.col("name"), 3), "n": C.is_count(F.col("n"))}, F.col("key"))
    assert sorted((r.rule, r.key or "") for r in found.collect()) == [("n", ""), ("n", "b"), ("name", ""), ("name", "b")]


def test_dependencies_and_duplicates_see_nulls(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "z"), (None, "q")], "k string, v string")
    assert [r.k for r in C.dependency_violations(rows, ["k"], "v").collect()] == ["b"]
    assert {(r.k, r.n_rows) for r in C.duplicates(rows, "k").collect()} == {("a", 2), ("b", 2)}


def test_accounts_give_up_room_for_numbered_members(spark):
    file = "struct<source_path string, filename string, size_bytes long, sha256 string>"
    accounts = spark.createDataFrame([("c", "Co", "d", "Div", "2026-01", "1", "77", "N" * 120, None)], f"company_id string, company_name string, division_id string, division_name string, period string, account_id string, account_code string, account_name string, cover {file}")
    attached = spark.createDataFrame([("1", f"{i:02}", f"s{i}", "same.pdf", 1, "0") for i in range(11)], "account_id string, document_id string, source_path string, filename string, size_bytes long, sha256 string")
    target = P.Target("/out", 100, "packages.zip")
    paths = [r.extraction_path for r in P.planned_members(accounts, attached, target).collect()]
    assert len(set(paths)) == 11
    assert max(map(len, paths)) == 100  # "same (11).pdf" is the longest, and it just fits
    pairs = P.named_archives(P.indexed(P.archives(accounts, P.expected_members(accounts, attached))))
    assert P.preflight_violations(P.planned_members(accounts, attached, target), pairs, target, 1 << 40).count() == 0

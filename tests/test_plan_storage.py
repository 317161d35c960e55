"""What a plan stores and shuffles of its members."""

import pytest

from foliospark.operators import planning
from foliospark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture
def kept(monkeypatch):
    """The columns of all that queries checkpoint or store, by way."""
    found = {"cut": [], "stored": []}
    for module in (planning, catalogue):
        for way in found:
            monkeypatch.setattr(module, way, lambda df, *a, f=getattr(module, way), way=way, **b: found[way].append(set(df.columns)) or f(df, *a, **b), raising=False)
    return found


@pytest.mark.parametrize("query", ["max_path_units", "archive_manifest"])
def test_named_members_are_not_stored(spark, kept, query):
    catalogue.QUERIES[query](spark, SF).collect()
    assert kept["cut"] and not any("member_name" in c or "member_path" in c for c in kept["cut"] + kept["stored"])


def test_checks_store_members_without_digests_and_compressed(spark, kept):
    catalogue.QUERIES["preflight_violations"](spark, SF).collect()
    assert not any("member_path" in c for c in kept["cut"])
    assert not any("member_path" in c and "sha256" in c for c in kept["stored"])


def test_members_go_to_their_archive_in_one_shuffle(spark):
    from foliospark.operators import packaging

    planned, pairs = catalogue._plan(spark, SF)
    planned = planned.localCheckpoint()
    plan = packaging._dealt(planned, pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_scopes_with_nulls_and_ties(spark):
    from foliospark.operators.naming import unique_names

    rows = [(None, 1, "a"), (None, 2, "a (2)"), (None, 3, "a"), ("s", 1, "a"), ("s", 1, "a (2)"), ("s", 2, "A")]
    found = unique_names(spark.createDataFrame(rows, "scope string, at int, name string"), ["scope"], ["at"], "name", "out", True).collect()
    assert sorted((r["scope"] or "", r["out"]) for r in found) == [("", "a"), ("", "a (2)"), ("", "a (3)"), ("s", "A (3)"), ("s", "a"), ("s", "a (2)")]

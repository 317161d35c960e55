"""Independent verification of finished packages against an inventory, as tables of violations."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions.canonical import is_strict_json, strict_object
from ..lineage import cut
from ..sources import zips
from ..sources.files import evidence_of, is_plain_output
from ..sources.inventory import Inventory
from . import packaging as K
from . import planning as P
from .constraints import has_just_the_keys, is_digest
from .evidence import name_collisions, reconcile

MANIFEST_KEYS = ["schema_version", "archive_index", "company_id", "division_id", "plan_sha256", "inventory_sha256", "members"]
MEMBER_KEYS = ["path", "account_id", "document_id", "kind", "category", "size_bytes", "sha256"]
SUMMARY_KEYS = {"schema_version", "status", "plan_sha256", "inventory_sha256", "master_created", "path_limit", "archive_count", "member_count", "output_bytes"}
MEMBER_TYPE = "struct<schema_version:bigint,archive_index:bigint,company_id:string,division_id:string,plan_sha256:string,inventory_sha256:string,members:array<string>>"


def entry_violations(entries: DataFrame) -> DataFrame:
    """(path, rule): unreadable archives, checksums, entries that are no regular files, names that collide on Windows."""
    rule = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("crc_ok"), "crc").when(~F.col("regular"), "not_regular")
    single = entries.select("path", rule.alias("rule")).filter("rule IS NOT NULL").distinct()
    twice = name_collisions(entries.filter("name IS NOT NULL").withColumn("key", N.folded("name")), ["path"], "key")
    return single.union(twice.select("path", F.lit("name_collision").alias("rule")))


def manifests(entries: DataFrame) -> DataFrame:
    """(path, manifest fields, sound) of each archive's manifest, which has to be its last entry."""
    last = entries.groupBy("path").agg(F.max_by("name", "position").alias("last"), F.sum((F.col("name") == K.MANIFEST).cast("int")).alias("n"))
    text = entries.filter(F.col("name") == K.MANIFEST).select("path", "text")
    found = last.join(text, "path", "left").withColumn("m", F.from_json("text", MEMBER_TYPE))
    sound = (F.col("last") == K.MANIFEST) & (F.col("n") == 1) & is_strict_json(F.col("text")) & has_just_the_keys(F.col("text"), MANIFEST_KEYS) & (F.col("m.schema_version") == 1)
    return found.select("path", "m.*", F.coalesce(sound, F.lit(False)).alias("sound"))


def listed_members(found: DataFrame) -> DataFrame:
    """Members that manifests list, at their positions."""
    kind = "struct<path:string,account_id:string,document_id:string,kind:string,category:string,size_bytes:bigint,sha256:string>"
    rows = found.select(F.col("path").alias("archive_path"), "company_id", "division_id", F.posexplode("members").alias("at", "member"))
    return rows.select("archive_path", "company_id", "division_id", "at", has_just_the_keys(F.col("member"), MEMBER_KEYS).alias("keys_ok"), F.from_json("member", kind).alias("m")).select("archive_path", "company_id", "division_id", "at", "keys_ok", "m.*")


def archive_violations(spark: SparkSession, output_dir: str, inventory: Inventory, planned: DataFrame | None, plan_sha: str, names: list[str], root: str | None = None, path_limit: int = P.LONGEST_PATH) -> DataFrame:
    """(path, rule) for archives of these names: their entries, manifests, listings, content and consistency with the inventory.

    With ``planned``, members have to be at the planned paths too.
    """
    paths = spark.createDataFrame([(os.path.join(output_dir, n),) for n in names], "path string")
    entries = cut(zips.entries(paths))
    found = cut(manifests(entries))
    expected = cut(P.expected_members(inventory.accounts, inventory.attachments))
    order = P.indexed(inventory.accounts.select(*P.PAIR).distinct())
    wrong_head = found.join(order.withColumnsRenamed({"company_id": "c", "division_id": "d", "archive_index": "i"}), (F.col("c") == F.col("company_id")) & (F.col("d") == F.col("division_id")), "left")
    head_ok = F.col("sound") & (F.col("i") == F.col("archive_index")) & (F.col("plan_sha256") == plan_sha) & (F.col("inventory_sha256") == inventory.sha256)
    violations = entry_violations(entries).union(wrong_head.filter(~F.coalesce(head_ok, F.lit(False))).select("path", F.lit("manifest")))
    members = listed_members(found)
    there = entries.filter(F.col("name") != K.MANIFEST).select(F.col("path").alias("archive_path"), F.col("position").alias("at"), "name", F.col("size_bytes").alias("seen_bytes"), F.col("sha256").alias("seen_sha256"))
    both = members.join(there, ["archive_path", "at"], "full_outer")
    content_ok = F.col("path").eqNullSafe(F.col("name")) & (F.col("size_bytes") == F.col("seen_bytes")) & (F.col("sha256") == F.col("seen_sha256")) & F.col("keys_ok") & is_digest(F.col("sha256"), lower_only=True)
    violations = violations.union(both.filter(~F.coalesce(content_ok, F.lit(False))).select("archive_path", F.lit("content")))
    declared = expected.select(*P.PAIR, "kind", "account_id", "document_id", "period", "account_code", "account_name", "filename", F.col("size_bytes").alias("e_bytes"), F.col("sha256").alias("e_sha256"), F.col("category").alias("e_category"))
    joined = members.alias("m").join(declared.alias("e"), (F.col("m.kind") == F.col("e.kind")) & (F.col("m.account_id") == F.col("e.account_id")) & F.col("m.document_id").eqNullSafe(F.col("e.document_id")), "left")
    base = F.col("archive_path")
    unpacked = F.concat_ws("/", F.lit(root or output_dir), N.stem_of(F.element_at(F.split(base, "/"), -1)), F.col("m.path"))
    agrees = (
        (F.col("m.company_id") == F.col("e.company_id")) & (F.col("m.division_id") == F.col("e.division_id")) & (F.col("m.category") == F.col("e_category")) & (F.col("m.size_bytes") == F.col("e_bytes"))
        & (F.col("m.sha256") == F.lower("e_sha256")) & member_path_agrees(F.col("m.path")) & (N.utf16_units(unpacked) <= path_limit)
    )
    violations = violations.union(joined.filter(~F.coalesce(agrees, F.lit(False))).select("archive_path", F.lit("metadata")))
    if planned is not None:
        at = planned.select("account_id", "document_id", F.col("member_path").alias("planned_path"))
        off = members.alias("m").join(at.alias("p"), (F.col("m.account_id") == F.col("p.account_id")) & F.col("m.document_id").eqNullSafe(F.col("p.document_id")), "left")
        violations = violations.union(off.filter(~F.col("m.path").eqNullSafe(F.col("planned_path"))).select("archive_path", F.lit("path")))
    return violations


def member_path_agrees(path) -> F.Column:
    """Whether a listed path is one that the joined declaration allows: period, ``code - name…``, category, file name, numbers aside."""
    part = lambda i: F.get(F.split(path, "/"), F.lit(i))
    safe = F.lit(True)
    for i in range(4):
        safe = safe & (N.safe_component(F.coalesce(part(i), F.lit("."))) == part(i))
    prefix = F.concat(N.safe_component(F.col("account_code")), F.lit(" - "))
    shown = N.without_number(F.substr(part(1), F.length(prefix) + 1))
    wanted = N.safe_component(F.col("filename"))
    same_file = N.casefolded(part(3)) == N.casefolded(wanted)
    renumbered = (N.casefolded(N.suffix_of(part(3))) == N.casefolded(N.suffix_of(wanted))) & (N.casefolded(N.without_number(N.stem_of(part(3)))) == N.casefolded(N.stem_of(wanted)))
    return (
        (F.size(F.split(path, "/")) == 4) & ~path.contains("\\") & ~path.contains(":") & safe & (part(0) == F.col("period")) & (part(2) == F.col("e_category"))
        & F.startswith(N.casefolded(part(1)), N.casefolded(prefix)) & (F.length(shown) > 0) & F.startswith(N.casefolded(N.safe_component(F.col("account_name"))), N.casefolded(shown)) & (same_file | renumbered)
    )


def master_problem(spark: SparkSession, output_dir: str, listed: list[dict], plan_sha: str, inventory_sha: str) -> str | None:
    """Why the archive of archives is refused; ``listed`` is what it has to hold, in order."""
    place = os.path.join(output_dir, K.MASTER)
    rows = list(zips.entries_of(place))
    if any(r[8] or not r[3] or not r[6] for r in rows):
        return "master_entries"
    if [r[2] for r in rows] != [*(x["path"] for x in listed), K.MASTER_MANIFEST]:
        return "master_listing"
    try:
        manifest = strict_object(rows[-1][7])
    except ValueError:
        return "master_manifest"
    if manifest != {"schema_version": 1, "plan_sha256": plan_sha, "inventory_sha256": inventory_sha, "archives": listed} or manifest["schema_version"] is True:
        return "master_manifest"
    return None if all((r[4], r[5]) == (x["size_bytes"], x["sha256"]) for r, x in zip(rows, listed, strict=False)) else "master_content"


def verify_job(spark: SparkSession, output_dir: str, inventory: Inventory) -> dict:
    """valid, archive_count, member_count, output_bytes and issues; the counts are zero and one issue is named if anything is wrong."""
    failed = lambda issue: {"valid": False, "archive_count": 0, "member_count": 0, "output_bytes": 0, "issues": [issue]}
    out = os.path.realpath(os.path.expanduser(output_dir))
    place = os.path.join(out, K.SUMMARY)
    try:
        if not is_plain_output(place, out):
            return failed("summary")
        with open(place, encoding="utf-8") as f:
            summary = strict_object(f.read())
    except (OSError, ValueError):
        return failed("summary")
    expected = cut(P.expected_members(inventory.accounts, inventory.attachments))
    ordered = [tuple(r) for r in P.indexed(inventory.accounts.select(*P.PAIR).distinct()).orderBy("archive_index").select(*P.PAIR).toLocalIterator()]
    n = expected.count()
    count = lambda v: type(v) is int and v >= 0
    digest = lambda v: isinstance(v, str) and len(v) == 64 and set(v) <= set("0123456789abcdef")
    if (
        set(summary) != SUMMARY_KEYS or type(summary["schema_version"]) is not int or summary["schema_version"] != 1 or summary["status"] != "COMPLETE" or not digest(summary["plan_sha256"])
        or summary["inventory_sha256"] != inventory.sha256 or type(summary["master_created"]) is not bool or not count(summary["path_limit"]) or not 1 <= summary["path_limit"] <= P.LONGEST_PATH
        or summary["archive_count"] != len(ordered) or summary["member_count"] != n or not count(summary["output_bytes"]) or not count(summary["archive_count"]) or not count(summary["member_count"])
    ):
        return failed("summary")
    zips_there = sorted(x for x in os.listdir(out) if x.lower().endswith(".zip") and os.path.isfile(os.path.join(out, x)))
    names = [x for x in zips_there if x != K.MASTER]
    if summary["master_created"] != (K.MASTER in zips_there) or len(names) != len(ordered) or not all(is_plain_output(os.path.join(out, x), out) for x in zips_there):
        return failed("archives")
    root = P.Target(out, summary["path_limit"], K.MASTER if summary["master_created"] else None).root()
    found = archive_violations(spark, out, inventory, None, summary["plan_sha256"], names, root, summary["path_limit"]).head(1)
    if found:
        return failed(found[0].rule)
    paths = spark.createDataFrame([(os.path.join(out, x),) for x in names], "path string")
    heads = cut(manifests(zips.entries(paths)))
    keys = ["kind", "account_id", "document_id"]
    if reconcile(expected, listed_members(heads), keys).filter("verdict <> 'ok'").head(1):
        return failed("coverage")
    by_index = {r.archive_index: (r.path, r.company_id, r.division_id) for r in heads.select("archive_index", "path", *P.PAIR).toLocalIterator()}
    if [by_index.get(i, ("",))[1:] for i in range(len(ordered))] != ordered:
        return failed("pairs")
    listed, total = [], 0
    for i in range(len(ordered)):
        path, company, division = by_index[i]
        size, sha = evidence_of(path)
        total += size
        listed.append({"path": os.path.basename(path), "company_id": company, "division_id": division, "size_bytes": size, "sha256": sha})
    if summary["master_created"]:
        if problem := master_problem(spark, out, listed, summary["plan_sha256"], inventory.sha256):
            return failed(problem)
        total += os.path.getsize(os.path.join(out, K.MASTER))
    if total != summary["output_bytes"]:
        return failed("output_bytes")
    return {"valid": True, "archive_count": len(ordered), "member_count": n, "output_bytes": total, "issues": []}

"""The plan of packages: members, archives, sizes, paths and the checks before a build."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions.canonical import canonical
from ..functions.sizing import archive_bound, compressed_bound
from ..lineage import cut, release, stored
from .constraints import CATEGORIES
from .naming import account_folders, unique_names

PAIR = ["company_id", "division_id"]
#: The longest path in UTF-16 units that is ever allowed. A fixed value.
LONGEST_PATH = 185


@dataclass(frozen=True)
class Target:
    """Where packages go, and whether one archive of all archives is made too."""

    output_dir: str
    path_limit: int = LONGEST_PATH
    master: str | None = None

    def root(self) -> str:
        """The folder under which archives are unpacked."""
        return self.output_dir + ("/" + self.master.removesuffix(".zip") if self.master else "")


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accounts and attachments of records that carry both."""
    return records.filter("record_type = 'account'"), records.filter("record_type = 'attachment'")


ABOUT = [*PAIR, "period", "account_id", "account_code", "account_name"]


def _expected(accounts: DataFrame, attachments: DataFrame, *more: str) -> list[DataFrame]:
    """Covers and attachments by themselves, with the account's columns, ``more`` of them if named."""
    about, files = [*ABOUT, *more], ["source_path", "filename", "size_bytes", "sha256"]
    covers = accounts.filter("cover IS NOT NULL").select(*about, F.lit(None).cast("string").alias("document_id"), *(F.col(f"cover.{f}").alias(f) for f in files))
    others = attachments.join(accounts.select(*about), "account_id").select(*about, "document_id", *files)
    kind = F.when(F.col("document_id").isNull(), "cover").otherwise("attachment")
    category = F.when(F.col("kind") == "cover", CATEGORIES["cover"]).otherwise(CATEGORIES["attachment"])
    return [rows.withColumn("kind", kind).withColumn("category", category) for rows in (covers, others)]


def expected_members(accounts: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row a file: each account's cover and its attachments, with the account's columns."""
    covers, others = _expected(accounts, attachments)
    return covers.unionByName(others)


def named_members(members: DataFrame, ascii_only: bool = False) -> DataFrame:
    """With ``member_name``: safe, and unique in its account and category in order of document_id."""
    safe = members.withColumn("safe_name", N.safe_component(F.col("filename"), ascii_only))
    return unique_names(safe, ["account_id", "category"], ["document_id"], "safe_name", "member_name", ascii_only)


def _named(accounts: DataFrame, attachments: DataFrame, ascii_only: bool, *more: str) -> DataFrame:
    """``named_members`` of ``expected_members``. An attachment without an id counts as a cover, so only where none is are the two,
    whose categories differ, named apart: rows stored by account then need no shuffle.
    """
    covers, others = _expected(accounts, attachments, *more)
    bare = F.col("document_id").isNull()
    apart = [covers.unionByName(others.filter(bare)), others.filter(~bare)]
    return named_members(apart[0], ascii_only).unionByName(named_members(apart[1], ascii_only))


def archives(accounts: DataFrame, members: DataFrame) -> DataFrame:
    """One row a pair, pairs without members too: its members, their bytes and the bound of its archive."""
    pairs = accounts.groupBy(*PAIR).agg(F.min("company_name").alias("company_name"), F.min("division_name").alias("division_name"), F.count("*").alias("n_accounts"))
    sums = members.groupBy(*PAIR).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.sum(compressed_bound(F.col("size_bytes"))).alias("compressed"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return pairs.join(sums, PAIR, "left").select(
        *PAIR, "company_name", "division_name", "n_accounts", n.alias("member_count"), F.coalesce("bytes", F.lit(0)).cast("long").alias("member_bytes"), archive_bound(n, F.col("compressed")).alias("bound_bytes")
    )


def indexed(pairs: DataFrame) -> DataFrame:
    """With ``archive_index``, from 0 in order of company and division. There is one row a pair, and no member, to be ordered."""
    return pairs.withColumn("archive_index", F.row_number().over(Window.orderBy(*PAIR)).cast("long") - 1)


def named_archives(pairs: DataFrame, ascii_only: bool = False) -> DataFrame:
    """With ``filename``: ``company - division.zip``, unique over the plan in order of company and division."""
    base = F.concat(N.safe_component(F.col("company_name"), ascii_only), F.lit(" - "), N.safe_component(F.col("division_name"), ascii_only), F.lit(".zip"))
    return unique_names(pairs.withColumn("wanted", base), [], PAIR, "wanted", "filename", ascii_only).drop("wanted")


def plan_bound(pairs: DataFrame, master: bool) -> DataFrame:
    """One row: archives, members, and the bytes that all archives, and one of them all, need at most."""
    bound = F.coalesce(F.sum("bound_bytes"), F.lit(0))
    if master:
        bound = bound + archive_bound(F.count("*"), F.sum(compressed_bound(F.col("bound_bytes"))))
    return pairs.agg(F.count("*").alias("archive_count"), F.coalesce(F.sum("member_count"), F.lit(0)).cast("long").alias("member_count"), bound.cast("long").alias("required_bytes"))


def planned_members(accounts: DataFrame, attachments: DataFrame, target: Target, ascii_only: bool = False) -> DataFrame:
    """All members with archive, path in it and path when unpacked: the whole plan.

    Members are named twice, for the room that they leave to their accounts' names and then in the folders named so. Folders
    join the accounts, which are few beside members: a member is shuffled once, by its account, and not at all
    where it is stored by account.
    """
    spark = accounts.sparkSession
    # What lies by account stays so where the pair is a key too.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    labels = accounts.groupBy(*PAIR).agg(F.min("company_name").alias("company_name"), F.min("division_name").alias("division_name"))
    pairs = cut(named_archives(indexed(labels), ascii_only))
    root = F.concat(F.lit(target.root() + "/"), N.stem_of(F.col("filename")))
    pairs = pairs.select(*PAIR, "archive_index", F.col("filename").alias("archive"), root.alias("root"))
    placed = accounts.select(*ABOUT, "cover").join(F.broadcast(pairs) if pairs.count() <= 20_000 else pairs, PAIR)
    # What is left for an account's name beside the longest of its members as named, the name standing for one character.
    prefix = F.concat(N.safe_component(F.col("account_code"), ascii_only), F.lit(" - x"))
    probe = F.concat_ws("/", "root", "period", prefix, "category", "member_name")
    room = F.least(F.lit(target.path_limit), F.min(F.lit(target.path_limit + 1) - N.utf16_units(probe)))
    wanted = stored(_named(placed, attachments, ascii_only, "root").groupBy(*ABOUT).agg(room.alias("name_units")))
    release(spark)  # of the members
    homes = stored(placed.join(account_folders(wanted, ascii_only), [*PAIR, "account_id"]), by="account_id")
    release(spark)  # of the folders
    members = _named(homes, attachments, ascii_only, "archive_index", "archive", "root", "folder")
    path = F.concat_ws("/", "period", "folder", "category", "member_name")
    return members.withColumn("member_path", path).withColumn("extraction_path", F.concat_ws("/", "root", "member_path"))


def max_path_units(planned: DataFrame, pairs: DataFrame, target: Target) -> DataFrame:
    """One row: the longest of all archive and extraction paths in UTF-16 units."""
    paths = planned.select(F.col("extraction_path").alias("path")).union(pairs.select(F.concat(F.lit(target.output_dir + "/"), "filename")))
    longest = F.coalesce(F.max(N.utf16_units(F.col("path"))), F.lit(0))
    if target.master:
        longest = F.greatest(longest, N.utf16_units(F.lit(f"{target.output_dir}/{target.master}")))
    return paths.agg(longest.cast("long").alias("max_path_units"))


def colliding(rows: DataFrame, keys: list[Column], shown: str) -> DataFrame:
    """(key) the least ``shown`` of each group of rows with equal keys, two and more.

    Hashes of the keys are counted first, so that only rows whose hash is there again are compared by the keys themselves.
    """
    hashed = rows.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.col(shown).alias("key")).withColumn("h", F.xxhash64(*(f"k{i}" for i in range(len(keys)))))
    again = cut(hashed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    some = hashed.join(F.broadcast(again) if again.count() <= 20_000 else again, "h", "left_semi")
    return some.groupBy(*(f"k{i}" for i in range(len(keys)))).agg(F.count("*").alias("n"), F.min("key").alias("key")).filter("n > 1").select("key")


def preflight_violations(planned: DataFrame, pairs: DataFrame, target: Target, free_bytes: int, ascii_only: bool = False) -> DataFrame:
    """(rule, key) of what stands against a build: bad names, collisions, long paths, lack of space."""
    parts = F.split("member_path", "/")
    shaped = F.forall(parts, lambda p: ~p.isin("", ".", "..")) & ~F.col("member_path").contains("\\") & ~F.col("member_path").contains(":")
    # Each part has to be what making it safe gives back.
    safe = F.lit(True)
    for i in range(4):
        part = F.coalesce(parts[i], F.lit("_"))
        safe = safe & (N.safe_component(part, ascii_only) == part)
    rules = {
        "member_name": planned.filter(~(shaped & safe)).select(F.col("member_path").alias("key")),
        "member_collision": colliding(planned, [F.col("archive_index"), N.key_of(F.col("member_path"), ascii_only)], "member_path"),
        "extraction_collision": colliding(planned, [N.key_of(F.col("extraction_path"), ascii_only)], "extraction_path"),
        "archive_name": pairs.filter((N.safe_component(F.col("filename"), ascii_only) != F.col("filename")) | ~F.lower("filename").endswith(".zip")).select(F.col("filename").alias("key")),
        "archive_collision": pairs.groupBy(N.key_of(F.col("filename"), ascii_only).alias("k")).agg(F.count("*").alias("n"), F.min("filename").alias("key")).filter("n > 1").select("key"),
        "path_limit": planned.filter(N.utf16_units(F.col("extraction_path")) > target.path_limit).select(F.col("extraction_path").alias("key")),
        "free_space": plan_bound(pairs, bool(target.master)).filter(F.col("required_bytes") > free_bytes).select(F.col("required_bytes").cast("string").alias("key")),
    }
    found = None
    for rule, rows in rules.items():
        named = rows.select(F.lit(rule).alias("rule"), "key")
        found = named if found is None else found.union(named)
    return found


def check_target(target: Target, free_bytes: int) -> None:
    """ValueError for arguments that no plan can have."""
    if type(free_bytes) is not int or free_bytes < 0 or type(target.path_limit) is not int or not 1 <= target.path_limit <= LONGEST_PATH or not target.output_dir.startswith("/"):
        raise ValueError("the target's or the space's value is out of range")


def plan_digest(planned: DataFrame, pairs: DataFrame, inventory_sha256: str, target: Target) -> str:
    """SHA-256 of the plan's canonical JSON. Rows come to the driver in order, a partition at a time, and only pass through the digest."""
    digest = hashlib.sha256(b'{"archives":[')
    order = [N.key_of(F.col("member_path")), F.col("member_path")]
    fields = ("account_id", "document_id", "source_path", "member_path", "size_bytes", "sha256")
    members = planned.select("archive_index", *fields).orderBy("archive_index", *order).toLocalIterator(prefetchPartitions=True)
    ahead = next(members, None)
    for i, pair in enumerate(pairs.select("archive_index", *PAIR, "filename").orderBy("archive_index").toLocalIterator()):
        head = canonical({"company_id": pair.company_id, "division_id": pair.division_id, "filename": pair.filename, "index": pair.archive_index})[:-1]
        digest.update((b"," if i else b"") + head + b',"members":[')
        first = True
        while ahead is not None and ahead.archive_index == pair.archive_index:
            digest.update((b"" if first else b",") + canonical({f: ahead[f] for f in fields}))
            ahead, first = next(members, None), False
        digest.update(b"]}")
    rest = {"inventory_sha256": inventory_sha256, "master_filename": target.master, "path_limit": target.path_limit, "schema_version": 1}
    digest.update(b"]," + json.dumps(rest, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()[1:])
    return digest.hexdigest()

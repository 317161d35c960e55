"""The catalogue of queries over the projected inventory, and the DuckDB SQL that checks them."""

from __future__ import annotations

import os
import re
import uuid
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions import redaction as R
from ..functions.canonical import is_strict_json
from ..functions.sizing import compressed_bound
from ..lineage import cut, release, shared_folder, stored
from ..operators import constraints as C
from ..operators import evidence as E
from ..operators import journal as J
from ..operators import packaging as K
from ..operators import planning as P
from ..operators.naming import unique_names
from . import fixtures as X
from .sql import SQL as ORACLE_SQL  # noqa: F401

#: Where the plans of the queries put packages. Every name in the star schema is ASCII, so keys stay in the JVM.
TARGET = P.Target("/srv/packages", 185, "packages.zip")
#: Archives of a journal's build in the queries on journals.
JOURNAL_ARCHIVES = 3
JOURNAL_ORDER = ["ts", "event_id"]


def tagged_split_counts(spark: SparkSession, d: str) -> DataFrame:
    a = X.accounts(spark, d).select(F.lit("account").alias("record_type"), F.col("account_id").alias("id"))
    records = a.unionByName(X.attachments(spark, d).select(F.lit("attachment").alias("record_type"), F.col("document_id").alias("id")))
    accounts, attachments = P.split_records(records)
    return accounts.unionByName(attachments).groupBy("record_type").agg(F.count("*").alias("n_records"))


def status_cover_violations(spark: SparkSession, d: str) -> DataFrame:
    # Orders on hold are made to declare what their status does not allow, so that both rules have cases.
    orders = X.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("account_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"), F.when(F.col("o_orderpriority").startswith("1") == (F.col("o_orderstatus") == "F"), F.lit(None)).otherwise(F.lit("cover.pdf")).alias("cover"))
    return C.cover_violations(orders)


def field_constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    customers = X.read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.col("c_name").alias("name"), F.floor("c_acctbal").cast("long").alias("amount"))
    parts = X.read(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("key"), F.col("p_name").alias("name"), (F.col("p_size") - 10).cast("long").alias("amount"))
    rules = {"name": C.text_within(F.col("name"), 16), "amount": C.is_count(F.col("amount")), "digest": C.is_digest(F.sha2("name", 256), lower_only=True)}
    return C.field_violations(customers.union(parts), rules, F.col("key"))


def duplicate_document_ids(spark: SparkSession, d: str) -> DataFrame:
    return C.duplicates(X.read(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


def orphan_attachments(spark: SparkSession, d: str) -> DataFrame:
    done = X.read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("account_id"))
    return C.orphans(X.attachments(spark, d), done, "account_id").select("document_id", "account_id")


def label_consistency(spark: SparkSession, d: str) -> DataFrame:
    return C.dependency_violations(X.read(spark, d, "part"), ["p_name"], "p_brand")


def first_violation(spark: SparkSession, d: str) -> DataFrame:
    lines = X.read(spark, d, "lineitem")
    rule = F.when(F.col("l_quantity") > 49, "quantity").when(F.col("l_discount") > 0.09, "discount").when((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.07), "tax")
    broken = lines.select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"), rule.alias("rule")).filter("rule IS NOT NULL")
    return C.first_violation(broken, ["l_suppkey"], "line_no", "rule")


def record_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    o = X.read(spark, d, "orders")
    kind = F.when(F.col("o_orderpriority").startswith("5"), "memo").otherwise("account")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("partial")
    told = C.diagnosis(kind, status, F.col("o_totalprice") > 250_000, F.col("o_custkey") % 10 != 0)
    return o.select(F.col("o_orderkey").alias("line_no"), told.alias("diagnosis")).filter("diagnosis IS NOT NULL")


def archive_groups(spark: SparkSession, d: str) -> DataFrame:
    a = X.accounts(spark, d)
    return a.groupBy(*P.PAIR).agg(F.count("*").alias("n_accounts"), F.sum((F.col("status") == "completed").cast("long")).alias("n_completed"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def archive_index(spark: SparkSession, d: str) -> DataFrame:
    return P.indexed(X.accounts(spark, d).select(*P.PAIR).distinct())


def archives_including_empty(spark: SparkSession, d: str) -> DataFrame:
    # A pair for each customer and segment, without covers and with returned lines only, so that some pairs have no member at all.
    own = X.accounts(spark, d).withColumn("company_id", F.col("account_code"))
    bare = own.withColumn("cover", F.lit(None).cast(own.schema["cover"].dataType))
    returned = X.read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("document_id")).distinct()
    some = X.attachments(spark, d).join(returned, "document_id", "left_semi")
    return P.archives(bare, P.expected_members(bare, some)).select(*P.PAIR, "member_count", "bound_bytes")


def planned_members(spark: SparkSession, d: str) -> DataFrame:
    return P.expected_members(X.accounts(spark, d), X.attachments(spark, d)).select(*P.PAIR, "period", "account_id", "document_id", "kind", "category", "filename", "size_bytes")


def unique_member_names(spark: SparkSession, d: str) -> DataFrame:
    return P.named_members(X.attachments(spark, d).withColumn("category", F.lit("Anexos")), ascii_only=True).select("account_id", "document_id", "member_name")


def unique_archive_names(spark: SparkSession, d: str) -> DataFrame:
    # Named after nations alone, so that the divisions of a nation collide.
    pairs = X.accounts(spark, d).select(*P.PAIR, F.col("company_name")).distinct()
    named = unique_names(pairs.withColumn("wanted", F.concat(N.safe_component(F.col("company_name"), True), F.lit(".zip"))), [], P.PAIR, "wanted", "filename", ascii_only=True)
    return named.select(*P.PAIR, "filename")


def account_folders(spark: SparkSession, d: str) -> DataFrame:
    # One folder a segment and month: accounts of one customer there collide.
    a = X.accounts(spark, d).select(F.lit("all").alias("company_id"), "division_id", "period", "account_id", F.lit("acct").alias("account_code"), F.concat(F.lit("nation "), "company_name").alias("account_name"), F.lit(40).cast("long").alias("name_units"))
    from ..operators.naming import account_folders as folders

    return folders(a, ascii_only=True).select("division_id", "account_id", "folder")


def safe_component(spark: SparkSession, d: str) -> DataFrame:
    raw = X.read(spark, d, "part").select(F.concat("p_name", F.lit("?"), "p_type", F.lit(" . ")).alias("name")).union(X.read(spark, d, "pages").select("url")).union(X.read(spark, d, "nation").select(F.concat(F.lit("con."), "n_name")))
    return raw.distinct().select("name", N.safe_component(F.col("name"), ascii_only=True).alias("safe_name"))


def device_names(spark: SparkSession, d: str) -> DataFrame:
    stems = F.array(*(F.lit(x) for x in ("con", "COM", "lpt", "aux", "nul", "console")))
    made = X.read(spark, d, "nation").select(F.concat(F.element_at(stems, (F.col("n_nationkey") % 6 + 1).cast("int")), F.when(F.col("n_nationkey") % 6 == 1, (F.col("n_nationkey") % 10).cast("string")).otherwise(""), F.lit("."), F.lower("n_name")).alias("name"))
    return made.select("name", N.is_device(F.col("name")).alias("device"))


def utf16_units(spark: SparkSession, d: str) -> DataFrame:
    texts = X.read(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "text").union(X.read(spark, d, "pages").select(F.concat(F.lit("p"), "page_id"), "html"))
    return texts.select("key", N.utf16_units(F.coalesce("text", F.lit(""))).alias("units"))


def truncated_names(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "documents").select("doc_id", N.truncate_utf16(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\r\t]", " "), F.lit(40)).alias("name"))


def number_suffixes(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("p_partkey") % 5).cast("int")
    name = N.numbered(F.col("p_name"), n + 1, F.lit(".pdf"))
    made = X.read(spark, d, "part").select("p_partkey", name.alias("filename"))
    return made.select("p_partkey", "filename", N.stem_of(F.col("filename")).alias("stem"), N.suffix_of(F.col("filename")).alias("suffix"), N.without_number(N.stem_of(F.col("filename"))).alias("base"))


def compressed_bounds(spark: SparkSession, d: str) -> DataFrame:
    return X.attachments(spark, d).select("document_id", "size_bytes", compressed_bound(F.col("size_bytes")).alias("bound_bytes"))


def _archives(spark: SparkSession, d: str) -> DataFrame:
    a = X.accounts(spark, d)
    return P.archives(a, P.expected_members(a, X.attachments(spark, d)))


def archive_bound(spark: SparkSession, d: str) -> DataFrame:
    return _archives(spark, d).select(*P.PAIR, "member_count", "member_bytes", "bound_bytes")


def plan_bound(spark: SparkSession, d: str) -> DataFrame:
    return P.plan_bound(_archives(spark, d), master=True)


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The plan's members and its archives without their sizes. What members are made of is stored by account."""
    by_account = partial(stored, by="account_id")
    a = by_account(X.accounts(spark, d))
    attached = X.attachments(spark, d, by_account)
    release(spark)  # of the lines
    labels = a.groupBy(*P.PAIR).agg(F.min("company_name").alias("company_name"), F.min("division_name").alias("division_name"))
    return P.planned_members(a, attached, TARGET, ascii_only=True), cut(P.named_archives(P.indexed(labels), ascii_only=True))


def _sized_plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What the checks before a build read of members, stored as several of them do, and the archives with their sizes."""
    planned, pairs = _plan(spark, d)
    planned = stored(planned.select(*P.PAIR, "archive_index", "size_bytes", "member_path", "extraction_path"))
    # An archive stands for its accounts: their number is not read.
    return planned, cut(P.archives(pairs, planned).join(pairs.select(*P.PAIR, "archive_index", "filename"), P.PAIR))


def planned_paths(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)[0].select("archive_index", "archive", "account_id", "document_id", "member_path", "extraction_path")


def max_path_units(spark: SparkSession, d: str) -> DataFrame:
    return P.max_path_units(*_plan(spark, d), TARGET)


def preflight_violations(spark: SparkSession, d: str) -> DataFrame:
    # A limit of 105 units and a gigabyte of space, so that there is something to refuse.
    target = P.Target(TARGET.output_dir, 105, TARGET.master)
    planned, pairs = _sized_plan(spark, d)
    return P.preflight_violations(planned, pairs, target, 1 << 30, ascii_only=True).groupBy("rule").agg(F.count("*").alias("n"))


def preflight_summary(spark: SparkSession, d: str) -> DataFrame:
    planned, pairs = _sized_plan(spark, d)
    one = F.lit(1).alias("one")
    return P.plan_bound(pairs, True).select("*", one).join(P.max_path_units(planned, pairs, TARGET).select("*", one), "one").drop("one")


def content_evidence(spark: SparkSession, d: str) -> DataFrame:
    found = E.evidence(F.col("text"))
    return X.read(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in found.items()))


def content_mismatch(spark: SparkSession, d: str) -> DataFrame:
    docs = X.read(spark, d, "documents")
    found = E.evidence(F.col("text"))
    declared = docs.select("doc_id", F.col("n_chars").alias("size_bytes"), F.upper(F.sha2("text", 256)).alias("sha256"))
    return E.content_mismatches(declared, docs.select("doc_id", *(c.alias(n) for n, c in found.items())), "doc_id")


def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    found = E.evidence(F.col("text"))
    return E.duplicate_content(X.read(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in found.items())), "doc_id")


def coverage_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    members = P.expected_members(X.accounts(spark, d), X.attachments(spark, d)).select("kind", "account_id", "document_id")
    # What was observed: raw lines repeat keys, and covers of low accounts are not there.
    raw = X.read(spark, d, "lineitem").select(F.lit("attachment").alias("kind"), F.col("l_orderkey").cast("string").alias("account_id"), F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("document_id"))
    covers = X.read(spark, d, "orders").filter("o_orderstatus <> 'O' AND o_orderkey > 100").select(F.lit("cover"), F.col("o_orderkey").cast("string"), F.lit(None).cast("string"))
    return E.reconcile(members, raw.union(covers), ["kind", "account_id", "document_id"]).filter("verdict <> 'ok'")


def coverage_difference(spark: SparkSession, d: str) -> DataFrame:
    return E.differences(X.read(spark, d, "labels").select("doc_id"), X.read(spark, d, "documents").select("doc_id"))


def checkpoint_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    orders, events = X.read(spark, d, "orders"), X.read(spark, d, "events")
    plan = orders.select(F.col("o_custkey").alias("archive_index")).distinct()
    size = F.floor(F.sum(F.abs("value"))).cast("long")
    logged = events.filter("event_type IN ('view', 'click')").groupBy(F.col("user_id").alias("archive_index")).agg(size.alias("size_bytes")).withColumn("sha256", F.sha2(F.col("archive_index").cast("string"), 256))
    found = events.filter("event_type IN ('view', 'purchase')").groupBy(F.col("user_id").alias("archive_index")).agg(F.floor(F.sum(F.when(F.col("event_type") == "view", F.abs("value")).otherwise(F.lit(0.0)))).cast("long").alias("size_bytes")).withColumn("sha256", F.sha2(F.col("archive_index").cast("string"), 256))
    return E.checkpoints_against_plan(plan, logged, found).select("archive_index", "action")


def ordered_listing_difference(spark: SparkSession, d: str) -> DataFrame:
    a = X.accounts(spark, d)
    pairs = P.indexed(_archives(spark, d).select(*P.PAIR, "member_count"))
    listed = P.indexed(a.filter("status = 'completed'").groupBy(*P.PAIR).agg(F.count("*").alias("member_count")))
    return E.positional_differences(pairs, listed, "archive_index", [*P.PAIR, "member_count"])


def name_collisions(spark: SparkSession, d: str) -> DataFrame:
    return E.name_collisions(X.attachments(spark, d).select("account_id", F.lower("filename").alias("key")), ["account_id"], "key").select("account_id", "n_names", "n_keys")


def journal_sequence_violations(spark: SparkSession, d: str) -> DataFrame:
    return J.sequence_violations(X.journal(spark, d), "job", JOURNAL_ORDER, JOURNAL_ARCHIVES, master_expected=True).select("job", "event_id", "event", "rule")


def journal_state(spark: SparkSession, d: str) -> DataFrame:
    return J.state(X.journal(spark, d), "job", JOURNAL_ORDER)


def resume_conflicts(spark: SparkSession, d: str) -> DataFrame:
    # What an earlier job recorded: a pair for each customer's nation and segment, a member for each raw line, and a master.
    pairs = X.read(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct().agg(F.count("*").alias("archive_count"))
    lines = X.read(spark, d, "lineitem").agg(F.count("*").alias("member_count"))
    one = F.lit(1).alias("one")
    recorded = pairs.select("*", one).join(lines.select("*", one), "one").select("archive_count", "member_count", F.lit(True).alias("master_expected"))
    planned = P.plan_bound(_archives(spark, d), master=False).select("archive_count", "member_count", F.lit(False).alias("master_expected"))
    return J.resume_conflicts(recorded, planned)


def manifest_keys(spark: SparkSession, d: str) -> DataFrame:
    events = X.read(spark, d, "events")
    return events.select("event_id", C.has_just_the_keys(F.col("props"), ["k"]).alias("just_k"), is_strict_json(F.col("props")).alias("strict"))


def sensitive_field_names(spark: SparkSession, d: str) -> DataFrame:
    """All column names of the tables at hand, and some made of them."""
    names = sorted({c for t in ("customer", "supplier", "part", "orders", "events", "pages", "conversations", "documents") for c in X.read(spark, d, t).columns})
    made = [n for c in names for n in (c, c.upper(), f"user-{c}", f"{c} Email", f"{c}Token")] + ["job_id", "plan_sha256", "E-Mail", "accountName", "__name__"]
    fields = spark.createDataFrame([(n,) for n in made], "field string")
    return fields.select("field", R.sensitive_field(F.col("field")).alias("sensitive"), R.kept_as_is(F.col("field"), F.sha2("field", 256)).alias("kept"))


def pii_presence(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return X.read(spark, d, "documents").select("doc_id", *(R.has(text, k).alias(f"has_{k}") for k in (*R.PATTERNS, "assignment")))


def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "documents").select("doc_id", R.redacted(F.col("text")).alias("text"))


def redacted_emails(spark: SparkSession, d: str) -> DataFrame:
    """The one pattern of the chain that reads alike in every engine."""
    return X.read(spark, d, "documents").select("doc_id", F.regexp_replace("text", R.PATTERNS["email"], R.MARK).alias("text"))


def redacted_records(spark: SparkSession, d: str) -> DataFrame:
    events = X.read(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type", F.col("props").alias("note"))).alias("record"))
    from ..shipping import ship

    ship(spark)
    return events.select("event_id", R.redact_json("record").alias("record"))


def source_path_rules(spark: SparkSession, d: str) -> DataFrame:
    urls = X.read(spark, d, "pages").select(F.col("url").alias("path"))
    paths = urls.union(urls.select(F.regexp_replace("path", "^[a-z]+://", ""))).union(urls.select(F.regexp_replace("path", "^[a-z]+:/", ""))).union(urls.select(F.concat(F.lit("../"), F.regexp_replace("path", "^[a-z]+://", ""))))
    return paths.distinct().select("path", C.path_violation(F.col("path")).alias("rule"), C.is_canonical_member(F.col("path")).alias("canonical"))


def archive_manifest(spark: SparkSession, d: str) -> DataFrame:
    return K.manifest_digests(*_plan(spark, d), "1" * 64, "0" * 64)


def plan_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    planned, pairs = _plan(spark, d)
    return spark.createDataFrame([(P.plan_digest(planned, pairs, "0" * 64, TARGET),)], "plan_sha256 string")


def zip_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each host packed into a ZIP in memory and read back: names, sizes and digests, and whether all agree.

    A host's pages are dealt over archives of at most 256, so that none grows with its host.
    """
    import io
    import zipfile

    import pandas as pd

    from ..operators.packaging import LEVEL, MANIFEST, entry_info
    from ..shipping import ship

    ship(spark)
    host = F.regexp_extract("url", "://([^/:?#]+)", 1)
    place = F.row_number().over(Window.partitionBy("host", F.pmod(F.xxhash64("page_id"), F.lit(64))).orderBy("page_id")) - 1
    pages = X.read(spark, d, "pages").select(host.alias("host"), "page_id", "html").withColumn("part", F.concat_ws("-", F.pmod(F.xxhash64("page_id"), F.lit(64)).cast("string"), F.floor(place / 256).cast("string")))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        out, group = io.BytesIO(), group.sort_values("page_id")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=LEVEL) as archive:
            for r in group.itertuples():
                archive.writestr(entry_info(f"{r.page_id}.html"), r.html or "", compresslevel=LEVEL)
            archive.writestr(entry_info(MANIFEST), "{}", compresslevel=LEVEL)
        with zipfile.ZipFile(io.BytesIO(out.getvalue())) as archive:
            back = [archive.read(n) for n in archive.namelist()[:-1]]
            sound = archive.testzip() is None
        size = [len(x) for x in back]
        sha = [hashlib.sha256(x).hexdigest() for x in back]
        return pd.DataFrame({"page_id": group.page_id, "size_bytes": size, "sha256": sha, "sound": sound})

    return pages.groupBy("host", "part").applyInPandas(pack, "page_id long, size_bytes long, sha256 string, sound boolean")


def inventory_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Accounts written as JSON lines, with every hundredth broken by rule, decoded strictly and diagnosed."""
    from ..sources.inventory import parse

    a = X.accounts(spark, d)
    number = F.col("account_id").cast("long")
    line = F.to_json(F.struct(F.when(number % 100 == 1, "memo").otherwise("account").alias("record_type"), *(c for c in a.columns if c not in ("status", "cover")), F.when(number % 100 == 2, "done").otherwise(F.col("status")).alias("status"), F.when(number % 100 != 3, F.col("cover")).alias("cover")))
    line = F.when(number % 100 == 4, F.concat(line, F.lit(" x"))).when(number % 100 == 5, F.concat(F.lit('{"a":1,"a":2}'))).otherwise(line)
    return parse(a.select(number.alias("line_no"), F.encode(line, "UTF-8").alias("line"))).select("line_no", "record_type", "account_id", "diagnosis")


def inventory_file(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as one file of JSON lines, some of them blank or broken, read back in splits with their line numbers."""
    from ..sources.inventory import lines, parse

    key = F.col("c_custkey").cast("string")
    record = F.to_json(F.struct(
        F.lit("account").alias("record_type"), key.alias("account_id"), F.col("c_nationkey").cast("string").alias("company_id"), F.concat(F.lit("é "), F.col("c_nationkey").cast("string")).alias("company_name"),
        F.col("c_mktsegment").alias("division_id"), F.col("c_mktsegment").alias("division_name"), F.lit("2026-06").alias("period"), key.alias("account_code"), F.col("c_name").alias("account_name"),
        F.when(F.col("c_custkey") % 50 == 7, "done").otherwise("pending").alias("status"),
    ))
    text = F.when(F.col("c_custkey") % 50 == 3, " \t").when(F.col("c_custkey") % 50 == 5, F.concat(record, F.lit("}"))).otherwise(record)
    at = f"{shared_folder(spark)}/inventory-{uuid.uuid4().hex}"
    X.read(spark, d, "customer").select("c_custkey", text.alias("value")).coalesce(1).sortWithinPartitions("c_custkey").select("value").write.text(at)
    return parse(lines(spark, at)).select("line_no", "account_id", "company_name", "diagnosis")


def package_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A whole job over pages: sources and inventory written, read, planned, packed and verified, and every entry read back.

    Each host is an account with an archive of its own, each page an attachment. Files lie in the folder that driver and executors share.
    """
    from ..operators import verify as V
    from ..shipping import ship
    from ..sources import zips
    from ..sources.config import Project
    from ..sources.inventory import load

    ship(spark)
    at = re.sub("^file:/*", "/", shared_folder(spark)) + f"/job-{uuid.uuid4().hex}"
    host = F.regexp_extract("url", "://([^/:?#]+)", 1)
    pages = X.read(spark, d, "pages").select(F.col("page_id").cast("string").alias("document_id"), host.alias("account_id"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))

    def write(batches):
        for batch in batches:
            for name, content in zip(batch["filename"], batch["content"], strict=True):
                os.makedirs(f"{at}/src", exist_ok=True)
                with open(f"{at}/src/{name}", "wb") as f:
                    f.write(content)
            yield batch.drop(columns="content")

    named = pages.select(F.lit("attachment").alias("record_type"), "document_id", "account_id", F.concat("document_id", F.lit(".html")).alias("filename"), "content").withColumn("source_path", F.col("filename"))
    full = named.select("record_type", "document_id", "account_id", "source_path", "filename", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")
    files = cut(full.mapInPandas(write, full.drop("content").schema))
    hosts = files.select("account_id").distinct()
    about = {"company_id": "account_id", "company_name": "account_id", "account_name": "account_id"}
    fixed = {"division_id": "pages", "division_name": "Pages", "period": "2026-06", "account_code": "7", "status": "pending"}
    accounts = hosts.select(F.to_json(F.struct(F.lit("account").alias("record_type"), "account_id", *(F.col(c).alias(n) for n, c in about.items()), *(F.lit(v).alias(n) for n, v in fixed.items()))).alias("value"))
    accounts.union(files.select(F.to_json(F.struct(*files.columns)))).coalesce(1).write.text(f"{at}/lines")
    os.makedirs(f"{at}/out")
    project = Project(Path(f"{at}/lines"), Path(f"{at}/src"), Path(f"{at}/out"))
    inventory = load(spark, next(str(p) for p in Path(f"{at}/lines").glob("part-*")))
    K.build(spark, project, inventory)
    found = V.verify_job(spark, f"{at}/out", inventory)
    archives = spark.createDataFrame([(str(p),) for p in Path(f"{at}/out").glob("*.zip") if p.name != K.MASTER], "path string")
    entries = zips.entries(archives).filter(F.col("name") != K.MANIFEST)
    name = F.element_at(F.split("path", "/"), -1)
    return entries.select(name.alias("archive"), F.col("name").alias("member_path"), "size_bytes", "sha256", (F.col("crc_ok") & F.lit(found["valid"])).alias("sound"), F.lit(found["member_count"]).cast("long").alias("member_count"))


def folded_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names as keys by normalisation and case folding, the form that names in any script take, beside trimmed ones."""
    from ..shipping import ship

    ship(spark)
    padded = F.concat(F.lit("\t "), F.upper("p_name"), F.lit(" \n"))
    return X.read(spark, d, "part").select("p_partkey", N.key_of(F.upper("p_name")).alias("key"), N.casefolded(F.col("p_type")).alias("kind"), N.stripped(padded).alias("name"))


QUERIES = {f.__name__: f for f in (
    archive_bound, tagged_split_counts, status_cover_violations, field_constraint_violations, duplicate_document_ids, orphan_attachments, label_consistency, first_violation, record_diagnosis,
    archive_groups, archive_index, archives_including_empty, planned_members, unique_member_names, unique_archive_names, account_folders, safe_component, device_names, utf16_units, truncated_names,
    number_suffixes, compressed_bounds, plan_bound, planned_paths, max_path_units, preflight_violations, preflight_summary, content_evidence, content_mismatch, duplicate_content,
    coverage_reconciliation, coverage_difference, checkpoint_reconciliation, ordered_listing_difference, name_collisions, journal_sequence_violations, journal_state, resume_conflicts, manifest_keys,
    sensitive_field_names, pii_presence, redacted_documents, redacted_emails, redacted_records, source_path_rules, archive_manifest, plan_fingerprint, zip_round_trip, inventory_round_trip, inventory_file, package_round_trip, folded_keys,
)}

"""DuckDB SQL for the catalogue's queries, over the same Parquet tables."""

from __future__ import annotations

from ..functions import redaction as R
from .fixtures import SQL as VIEWS


def _with(body: str) -> str:
    """The projections before a query that may have WITH parts of its own (``-- then`` between)."""
    parts, _, last = body.rpartition("-- then")
    return "WITH " + VIEWS.strip() + (", " + parts.strip() if parts else "") + last


ASCII_SAFE = r"regexp_replace(trim(regexp_replace({x}, '[<>:\x22/\\|?*\x00-\x1F]', '_', 'g')), '[ .]+$', '')"
DEVICE = r"regexp_matches(regexp_replace(split_part({x}, '.', 1), '[ .]+$', ''), '(?i)^(?:CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|COM[1-9¹²³]|LPT[1-9¹²³])$')"
#: A bound of compressed bytes and one of an archive.
COMPRESSED = "({x} + ({x} + 16383) // 16384 * 5 + 64)"
ARCHIVES = f"""
sums AS (SELECT company_id, division_id, count(*) AS n, sum(size_bytes) AS bytes, sum({COMPRESSED.format(x="size_bytes")}) AS compressed FROM members GROUP BY ALL),
pairs AS (SELECT DISTINCT company_id, division_id FROM accounts),
bounds AS (SELECT company_id, division_id, CAST(coalesce(n, 0) AS BIGINT) AS member_count, CAST(coalesce(bytes, 0) AS BIGINT) AS member_bytes, CAST(4096 + coalesce(n, 0) * 16384 + coalesce(compressed, 0) AS BIGINT) AS bound_bytes
  FROM pairs LEFT JOIN sums USING (company_id, division_id))
"""
#: Names in an account and category: no part's name looks like a numbered one, so the rank among equals is the number.
NAMED = """
named AS (SELECT *, CASE WHEN r = 1 THEN filename ELSE replace(filename, '.pdf', '') || ' (' || r || ').pdf' END AS member_name
  FROM (SELECT *, row_number() OVER (PARTITION BY account_id, category, lower(filename) ORDER BY document_id) AS r FROM members)),
"""
#: The plan's paths: accounts' names need no cut here, and equal folders of a period rank by account.
PLAN = NAMED + """
indexed AS (SELECT company_id, division_id, min(company_name) AS company_name, row_number() OVER (ORDER BY company_id, division_id) - 1 AS archive_index FROM accounts GROUP BY company_id, division_id),
archive_names AS (SELECT *, company_name || ' - ' || division_id || '.zip' AS archive FROM indexed),
folder_accounts AS (SELECT DISTINCT company_id, division_id, period, account_id, account_code || ' - ' || account_name AS wanted FROM members),
folders AS (SELECT account_id, CASE WHEN r = 1 THEN wanted ELSE wanted || ' (' || r || ')' END AS folder
  FROM (SELECT *, row_number() OVER (PARTITION BY company_id, division_id, period, lower(wanted) ORDER BY account_id) AS r FROM folder_accounts)),
plan AS (SELECT i.archive_index, i.archive, n.*, n.period || '/' || f.folder || '/' || n.category || '/' || n.member_name AS member_path
  FROM named n JOIN archive_names i ON i.company_id = n.company_id AND i.division_id = n.division_id JOIN folders f ON f.account_id = n.account_id),
paths AS (SELECT *, '/srv/packages/packages/' || replace(archive, '.zip', '') || '/' || member_path AS extraction_path FROM plan)
"""
LONGEST = "greatest((SELECT max(len(extraction_path)) FROM paths), (SELECT max(len('/srv/packages/' || archive)) FROM archive_names), len('/srv/packages/packages.zip'))"
REQUIRED = f"CAST(sum(bound_bytes) + 4096 + count(*) * 16384 + sum({COMPRESSED.format(x='bound_bytes')}) AS BIGINT)"
MEMBER_JSON = """'{"account_id":"' || account_id || '","category":"' || category || '","document_id":' || coalesce('"' || document_id || '"', 'null') || ',"kind":"' || kind || '","path":"' || member_path || '","sha256":"' || sha256 || '","size_bytes":' || size_bytes || '}'"""
PLAN_JSON = """'{"account_id":"' || account_id || '","document_id":' || coalesce('"' || document_id || '"', 'null') || ',"member_path":"' || member_path || '","sha256":"' || sha256 || '","size_bytes":' || size_bytes || ',"source_path":"' || source_path || '"}'"""
#: Whether a pattern occurs: RE2 has no look-around, but a border that is no digit or word character does as well for that.
DIGITS = {k: r"(?:^|[^0-9])(?:" + R.PATTERNS[k].replace(r"(?<!\d)", "").replace(r"(?!\d)", "").replace(r"\d", "[0-9]") + r")(?:[^0-9]|$)" for k in ("cnpj", "cpf", "phone")}
OCCURS = DIGITS | {
    "url": R.PATTERNS["url"], "bearer": R.PATTERNS["bearer"], "email": R.PATTERNS["email"], "assignment": R.ASSIGNMENT,
    "unc": r"(?:^|[^\pL\pM\pN_])" + R.PATTERNS["unc"].removeprefix(r"(?<!\w)"),
    "windows": r"(?:^|[^A-Za-z0-9])" + R.PATTERNS["windows"].removeprefix("(?<![A-Za-z0-9])"),
    "posix": r"(?:^|[^\pL\pM\pN_:])" + R.PATTERNS["posix"].removeprefix(r"(?<![\w:])"),
}


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _edges(pattern: str) -> tuple[str, bool, bool]:
    """A pattern without look-around, which RE2 lacks, its borders as groups before and behind; and whether it has them."""
    before, behind = "", ""
    for look, border in ((r"(?<!\d)", r"(^|[^0-9])"), (r"(?<!\w)", r"(^|[^\pL\pM\pN_])"), ("(?<![A-Za-z0-9])", "(^|[^A-Za-z0-9])"), (r"(?<![\w:])", r"(^|[^\pL\pM\pN_:])")):
        if pattern.startswith(look):
            before, pattern = border, pattern.removeprefix(look)
    if pattern.endswith(r"(?!\d)"):
        behind, pattern = "([^0-9]|$)", pattern.removesuffix(r"(?!\d)")
    return f"{before}(?:{pattern}){behind}", bool(before), bool(behind)


def redacted_sql(text: str) -> str:
    """The chain of rules; one with a border behind runs twice, as a border that two matches share serves the first alone."""
    for pattern, put in R.TEXT_RULES:
        if put != R.MARK:
            return f"regexp_replace({text}, {quoted(pattern)}, '{put}', 'g')"
        bare, before, behind = _edges(pattern)
        put = (r"\1" if before else "") + put + (r"\2" if behind else "")
        for _ in range(1 + behind):
            text = f"regexp_replace({text}, {quoted(bare)}, '{put}', 'g')"
    return text


_fields = ("customer", "supplier", "part", "orders", "events", "pages", "conversations", "documents")
SQL = {
    "archive_bound": _with(ARCHIVES + "-- then\nSELECT * FROM bounds"),
    "tagged_split_counts": _with("SELECT 'account' AS record_type, count(*) AS n_records FROM accounts UNION ALL SELECT 'attachment', count(*) FROM attachments"),
    "status_cover_violations": """
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus = 'F' AS done, NOT (o_orderpriority LIKE '1%') = (o_orderstatus = 'F') AS covered FROM orders)
SELECT CASE WHEN done THEN 'completed_without_cover' ELSE 'pending_with_cover' END AS rule, key FROM o WHERE done <> covered""",
    "field_constraint_violations": """
WITH r AS (SELECT 'c' || c_custkey AS key, c_name AS name, CAST(floor(c_acctbal) AS BIGINT) AS amount FROM customer UNION ALL SELECT 'p' || p_partkey, p_name, p_size - 10 FROM part)
SELECT 'name' AS rule, key FROM r WHERE len(trim(name)) NOT BETWEEN 1 AND 16 UNION ALL SELECT 'amount', key FROM r WHERE amount < 0""",
    "duplicate_document_ids": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "orphan_attachments": _with("SELECT document_id, account_id FROM attachments WHERE account_id NOT IN (SELECT account_id FROM accounts WHERE status = 'completed')"),
    "label_consistency": "SELECT p_name, min(p_brand) AS least, max(p_brand) AS greatest FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
    "first_violation": """
WITH b AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS line_no, CASE WHEN l_quantity > 49 THEN 'quantity' WHEN l_discount > 0.09 THEN 'discount' WHEN l_returnflag = 'R' AND l_tax > 0.07 THEN 'tax' END AS rule FROM lineitem)
SELECT l_suppkey, min(line_no) AS line_no, arg_min(rule, row(line_no, rule)) AS rule FROM b WHERE rule IS NOT NULL GROUP BY 1""",
    "record_diagnosis": """
WITH o AS (SELECT o_orderkey AS line_no, o_orderpriority LIKE '5%' AS memo, o_orderstatus AS s, o_totalprice > 250000 AS covered, o_custkey % 10 <> 0 AS ok FROM orders),
t AS (SELECT line_no, CASE WHEN memo THEN 'unknown_record_type' WHEN s NOT IN ('F', 'O') THEN 'invalid_status' WHEN s = 'F' AND NOT covered THEN 'completed_without_cover' WHEN s = 'O' AND covered THEN 'pending_with_cover' WHEN NOT ok THEN 'invalid_record' END AS diagnosis FROM o)
SELECT * FROM t WHERE diagnosis IS NOT NULL""",
    "archive_groups": _with("SELECT company_id, division_id, count(*) AS n_accounts, count(*) FILTER (WHERE status = 'completed') AS n_completed, min(period) AS first_period, max(period) AS last_period FROM accounts GROUP BY 1, 2"),
    "archive_index": _with("SELECT company_id, division_id, row_number() OVER (ORDER BY company_id, division_id) - 1 AS archive_index FROM (SELECT DISTINCT company_id, division_id FROM accounts)"),
    "archives_including_empty": _with(f"""
returned AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS document_id FROM lineitem WHERE l_returnflag = 'R')
-- then
SELECT a.account_code AS company_id, a.division_id, count(t.document_id) AS member_count, CAST(4096 + count(t.document_id) * 16384 + coalesce(sum({COMPRESSED.format(x="t.size_bytes")}), 0) AS BIGINT) AS bound_bytes
FROM accounts a LEFT JOIN (SELECT * FROM attachments WHERE document_id IN (SELECT document_id FROM returned)) t USING (account_id) GROUP BY 1, 2"""),
    "planned_members": _with("SELECT company_id, division_id, period, account_id, document_id, kind, category, filename, size_bytes FROM members"),
    "unique_member_names": _with(NAMED.strip().rstrip(",") + "-- then\nSELECT account_id, document_id, member_name FROM named WHERE kind = 'attachment'"),
    "unique_archive_names": _with("""SELECT company_id, division_id, company_name || CASE WHEN r = 1 THEN '' ELSE ' (' || r || ')' END || '.zip' AS filename
FROM (SELECT *, row_number() OVER (PARTITION BY lower(company_name) ORDER BY company_id, division_id) AS r FROM (SELECT DISTINCT company_id, division_id, company_name FROM accounts))"""),
    "account_folders": _with("""SELECT division_id, account_id, 'acct - nation ' || company_name || CASE WHEN r = 1 THEN '' ELSE ' (' || r || ')' END AS folder
FROM (SELECT *, row_number() OVER (PARTITION BY division_id, period, company_name ORDER BY account_id) AS r FROM accounts)"""),
    "safe_component": f"""
WITH n AS (SELECT DISTINCT name FROM (SELECT p_name || '?' || p_type || ' . ' AS name FROM part UNION ALL SELECT url FROM pages UNION ALL SELECT 'con.' || n_name FROM nation)),
c AS (SELECT name, coalesce(nullif({ASCII_SAFE.format(x="name")}, ''), '_') AS clean FROM n)
SELECT name, CASE WHEN {DEVICE.format(x="clean")} THEN '_' || clean ELSE clean END AS safe_name FROM c""",
    "device_names": f"""
WITH n AS (SELECT ['con', 'COM', 'lpt', 'aux', 'nul', 'console'][n_nationkey % 6 + 1] || CASE WHEN n_nationkey % 6 = 1 THEN CAST(n_nationkey % 10 AS VARCHAR) ELSE '' END || '.' || lower(n_name) AS name FROM nation)
SELECT name, {DEVICE.format(x="name")} AS device FROM n""",
    "utf16_units": r"SELECT key, CAST(len(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) AS BIGINT) AS units FROM (SELECT 'd' || doc_id AS key, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'p' || page_id, coalesce(html, '') FROM pages)",
    "truncated_names": r"SELECT doc_id, substr(regexp_replace(coalesce(text, ''), '[\n\r\t]', ' ', 'g'), 1, 40) AS name FROM documents",
    "number_suffixes": r"""
WITH n AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' (' || (p_partkey % 5 + 1) || ')' END AS stem FROM part)
SELECT p_partkey, stem || '.pdf' AS filename, stem, '.pdf' AS suffix, regexp_replace(stem, ' \(\d+\)$', '') AS base FROM n""",
    "compressed_bounds": _with(f"SELECT document_id, size_bytes, CAST({COMPRESSED.format(x='size_bytes')} AS BIGINT) AS bound_bytes FROM attachments"),
    "plan_bound": _with(ARCHIVES + f"-- then\nSELECT count(*) AS archive_count, CAST(sum(member_count) AS BIGINT) AS member_count, {REQUIRED} AS required_bytes FROM bounds"),
    "planned_paths": _with(PLAN + "-- then\nSELECT archive_index, archive, account_id, document_id, member_path, extraction_path FROM paths"),
    "max_path_units": _with(PLAN + f"-- then\nSELECT CAST({LONGEST} AS BIGINT) AS max_path_units"),
    "preflight_violations": _with(PLAN + "," + ARCHIVES + f"""-- then
SELECT 'path_limit' AS rule, count(*) AS n FROM paths WHERE len(extraction_path) > 105 HAVING count(*) > 0
UNION ALL SELECT 'free_space', 1 FROM bounds HAVING {REQUIRED} > 1073741824"""),
    "preflight_summary": _with(PLAN + "," + ARCHIVES + f"-- then\nSELECT count(*) AS archive_count, CAST(sum(member_count) AS BIGINT) AS member_count, {REQUIRED} AS required_bytes, CAST({LONGEST} AS BIGINT) AS max_path_units FROM bounds"),
    "content_evidence": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents",
    "content_mismatch": "SELECT doc_id, n_chars AS size_bytes, CAST(strlen(text) AS BIGINT) AS seen_bytes, 'size' AS issue FROM documents WHERE strlen(text) <> n_chars",
    "duplicate_content": "SELECT sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes, count(*) AS n_files, min(doc_id) AS first_key FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "coverage_reconciliation": _with("""
observed AS (SELECT 'attachment' AS kind, CAST(l_orderkey AS VARCHAR) AS account_id, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS document_id FROM lineitem
  UNION ALL SELECT 'cover', CAST(o_orderkey AS VARCHAR), NULL FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey > 100),
both_sides AS (SELECT kind, account_id, document_id, 1 AS e, 0 AS o FROM members UNION ALL SELECT kind, account_id, document_id, 0, 1 FROM observed),
counted AS (SELECT kind, account_id, document_id, CAST(sum(e) AS BIGINT) AS n_expected, CAST(sum(o) AS BIGINT) AS n_observed FROM both_sides GROUP BY ALL)
-- then
SELECT *, CASE WHEN n_observed = 0 THEN 'missing' WHEN n_expected = 0 THEN 'unknown' WHEN n_observed > n_expected THEN 'repeated' ELSE 'missing' END AS verdict FROM counted WHERE n_expected <> n_observed"""),
    "coverage_difference": """
SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)""",
    "checkpoint_reconciliation": """
WITH plan AS (SELECT DISTINCT o_custkey AS i FROM orders),
logged AS (SELECT user_id AS i, CAST(floor(sum(abs(value))) AS BIGINT) AS b FROM events WHERE event_type IN ('view', 'click') GROUP BY 1),
found AS (SELECT user_id AS i, CAST(floor(sum(CASE WHEN event_type = 'view' THEN abs(value) ELSE 0 END)) AS BIGINT) AS b FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1),
alls AS (SELECT i FROM plan UNION SELECT i FROM logged UNION SELECT i FROM found)
SELECT a.i AS archive_index, CASE WHEN p.i IS NULL THEN 'unknown' WHEN l.i IS NULL AND f.i IS NULL THEN 'build' WHEN f.i IS NULL THEN 'missing' WHEN l.i IS NULL THEN 'adopt' WHEN l.b = f.b THEN 'reuse' ELSE 'diverging' END AS action
FROM alls a LEFT JOIN plan p ON p.i = a.i LEFT JOIN logged l ON l.i = a.i LEFT JOIN found f ON f.i = a.i""",
    "ordered_listing_difference": _with(ARCHIVES + """,
a AS (SELECT company_id, division_id, member_count, row_number() OVER (ORDER BY company_id, division_id) - 1 AS i FROM bounds),
b AS (SELECT company_id, division_id, count(*) AS member_count, row_number() OVER (ORDER BY company_id, division_id) - 1 AS i FROM accounts WHERE status = 'completed' GROUP BY 1, 2)
-- then
SELECT coalesce(a.i, b.i) AS archive_index FROM a FULL JOIN b ON a.i = b.i WHERE a.company_id IS DISTINCT FROM b.company_id OR a.division_id IS DISTINCT FROM b.division_id OR a.member_count IS DISTINCT FROM b.member_count"""),
    "name_collisions": _with("SELECT account_id, count(*) AS n_names, count(DISTINCT lower(filename)) AS n_keys FROM attachments GROUP BY 1 HAVING count(*) > count(DISTINCT lower(filename))"),
    "journal_sequence_violations": _with("""
numbered AS (SELECT *, row_number() OVER w AS place, event = 'ARCHIVE_VERIFIED' AND archive_index BETWEEN 0 AND 2 AND row_number() OVER (PARTITION BY job, event, archive_index ORDER BY ts, event_id) = 1 AS fresh FROM journal WINDOW w AS (PARTITION BY job ORDER BY ts, event_id)),
told AS (SELECT *, coalesce(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER b, 0) AS archives, coalesce(sum(CASE WHEN event = 'MASTER_VERIFIED' THEN 1 ELSE 0 END) OVER b, 0) AS masters, coalesce(sum(CASE WHEN event = 'COMPLETE' THEN 1 ELSE 0 END) OVER b, 0) AS completes
  FROM numbered WINDOW b AS (PARTITION BY job ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ruled AS (SELECT job, event_id, event, CASE WHEN place = 1 AND event <> 'START' THEN 'no_start' WHEN completes > 0 THEN 'after_complete' WHEN place > 1 AND event = 'START' THEN 'second_start'
    WHEN event = 'ARCHIVE_VERIFIED' AND archive_index NOT BETWEEN 0 AND 2 THEN 'index_range' WHEN event = 'ARCHIVE_VERIFIED' AND NOT fresh THEN 'index_repeated' WHEN event = 'ARCHIVE_VERIFIED' AND masters > 0 THEN 'archive_after_master'
    WHEN event = 'MASTER_VERIFIED' AND (masters > 0 OR archives < 3) THEN 'master' WHEN event = 'COMPLETE' AND (archives < 3 OR masters = 0) THEN 'premature_complete' WHEN event = 'UNKNOWN' THEN 'unknown_event' END AS rule FROM told)
-- then
SELECT * FROM ruled WHERE rule IS NOT NULL"""),
    "journal_state": _with("""SELECT job, count(*) AS n_events, count(*) FILTER (WHERE event = 'ARCHIVE_VERIFIED') AS n_checkpoints, count(*) FILTER (WHERE event = 'MASTER_VERIFIED') AS n_masters, count(*) FILTER (WHERE event = 'COMPLETE') AS n_completes,
CAST(coalesce(sum(size_bytes) FILTER (WHERE event = 'ARCHIVE_VERIFIED'), 0) AS BIGINT) AS checkpoint_bytes, arg_min(event, row(ts, event_id)) AS first_event, arg_max(event, row(ts, event_id)) AS last_event FROM journal GROUP BY job"""),
    "resume_conflicts": _with("""
recorded AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)) AS a, (SELECT count(*) FROM lineitem) AS m),
planned AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT company_id, division_id FROM accounts)) AS a, (SELECT count(*) FROM members) AS m)
-- then
SELECT field FROM (SELECT unnest([CASE WHEN r.a <> p.a THEN 'archive_count' END, CASE WHEN r.m <> p.m THEN 'member_count' END, 'master_expected']) AS field FROM recorded r, planned p) WHERE field IS NOT NULL"""),
    "manifest_keys": "SELECT event_id, json_keys(props) = ['k'] AS just_k, json_valid(props) AS strict FROM events",
    "sensitive_field_names": f"""
WITH c AS (SELECT DISTINCT column_name AS c FROM ({" UNION ALL ".join(f"SELECT column_name FROM (DESCRIBE SELECT * FROM {t})" for t in _fields)})),
n AS (SELECT unnest([c, upper(c), 'user-' || c, c || ' Email', c || 'Token']) AS field FROM c UNION ALL SELECT unnest(['job_id', 'plan_sha256', 'E-Mail', 'accountName', '__name__'])),
m AS (SELECT field, trim(regexp_replace(lower(field), '[^a-z0-9]+', '_', 'g'), '_') AS normal FROM n)
SELECT field, list_contains({list(R.FIELD_NAMES)!r}, normal) OR regexp_matches(normal, '(?:{"|".join(R.FIELD_ENDS)})$') AS sensitive, regexp_matches(lower(field), '(?:^|_)sha256$') AS kept FROM m""",
    "pii_presence": "SELECT doc_id, " + ", ".join(f"regexp_matches(coalesce(text, ''), {quoted(OCCURS[k])}) AS has_{k}" for k in (*R.PATTERNS, "assignment")) + " FROM documents",
    "redacted_emails": f"SELECT doc_id, regexp_replace(text, {quoted(R.PATTERNS['email'])}, '{R.MARK}', 'g') AS text FROM documents",
    "source_path_rules": r"""
WITH n AS (SELECT DISTINCT path FROM (SELECT url AS path FROM pages UNION ALL SELECT regexp_replace(url, '^[a-z]+://', '') FROM pages UNION ALL SELECT regexp_replace(url, '^[a-z]+:/', '') FROM pages UNION ALL SELECT '../' || regexp_replace(url, '^[a-z]+://', '') FROM pages)),
p AS (SELECT path, string_split(path, '/') AS parts FROM n),
q AS (SELECT *, list_has_any(parts, ['', '.', '..']) AS bad FROM p)
SELECT path, CASE WHEN path = '' THEN 'empty' WHEN contains(path, '\') THEN 'backslash' WHEN contains(path, ':') THEN 'colon' WHEN path LIKE '/%' THEN 'absolute' WHEN bad THEN 'segment' END AS rule,
  len(parts) = 4 AND NOT bad AND NOT contains(path, '\') AND NOT contains(path, ':') AS canonical FROM q""",
    "archive_manifest": _with(PLAN + f""",
listed AS (SELECT archive_index, string_agg({MEMBER_JSON}, ',' ORDER BY lower(member_path), member_path) AS ms FROM plan GROUP BY 1),
m AS (SELECT i.archive_index, '{{"archive_index":' || i.archive_index || ',"company_id":"' || company_id || '","division_id":"' || division_id || '","inventory_sha256":"' || repeat('0', 64) || '","members":[' || coalesce(ms, '')
    || '],"plan_sha256":"' || repeat('1', 64) || '","schema_version":1}}' AS j FROM archive_names i LEFT JOIN listed USING (archive_index))
-- then
SELECT archive_index, CAST(strlen(j) AS BIGINT) AS manifest_bytes, sha256(j) AS manifest_sha256 FROM m"""),
    "plan_fingerprint": _with(PLAN + f""",
listed AS (SELECT archive_index, string_agg({PLAN_JSON}, ',' ORDER BY lower(member_path), member_path) AS ms FROM plan GROUP BY 1),
m AS (SELECT string_agg('{{"company_id":"' || company_id || '","division_id":"' || division_id || '","filename":"' || archive || '","index":' || i.archive_index || ',"members":[' || coalesce(ms, '') || ']}}', ',' ORDER BY i.archive_index) AS j FROM archive_names i LEFT JOIN listed USING (archive_index))
-- then
SELECT sha256('{{"archives":[' || j || '],"inventory_sha256":"' || repeat('0', 64) || '","master_filename":"packages.zip","path_limit":185,"schema_version":1}}') AS plan_sha256 FROM m"""),
    "zip_round_trip": "SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size_bytes, sha256(coalesce(html, '')) AS sha256, true AS sound FROM pages",
    "inventory_round_trip": _with("""
r AS (SELECT CAST(account_id AS BIGINT) AS n, account_id, status FROM accounts),
d AS (SELECT n AS line_no, CASE n % 100 WHEN 4 THEN 'invalid_json' WHEN 5 THEN 'invalid_json' WHEN 1 THEN 'unknown_record_type' WHEN 2 THEN 'invalid_status' WHEN 3 THEN CASE WHEN status = 'completed' THEN 'completed_without_cover' END END AS diagnosis, account_id, n FROM r)
-- then
SELECT line_no, CASE WHEN n % 100 IN (4, 5) THEN NULL WHEN n % 100 = 1 THEN 'memo' ELSE 'account' END AS record_type, CASE WHEN n % 100 IN (4, 5) THEN NULL ELSE account_id END AS account_id, diagnosis FROM d"""),
    "inventory_file": """
WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS line_no FROM customer WHERE c_custkey IS NOT NULL)
SELECT line_no, CASE WHEN c_custkey % 50 <> 5 THEN CAST(c_custkey AS VARCHAR) END AS account_id, CASE WHEN c_custkey % 50 <> 5 THEN 'é ' || c_nationkey END AS company_name,
  CASE WHEN c_custkey % 50 = 5 THEN 'invalid_json' WHEN c_custkey % 50 = 7 THEN 'invalid_status' END AS diagnosis FROM c WHERE c_custkey % 50 <> 3""",
    "package_round_trip": """
SELECT regexp_extract(url, '://([^/:?#]+)', 1) || ' - Pages.zip' AS archive, '2026-06/7 - ' || regexp_extract(url, '://([^/:?#]+)', 1) || '/Anexos/' || page_id || '.html' AS member_path,
  CAST(strlen(coalesce(html, '')) AS BIGINT) AS size_bytes, sha256(coalesce(html, '')) AS sha256, true AS sound, (SELECT count(*) FROM pages) AS member_count FROM pages""",
    "folded_keys": "SELECT p_partkey, lower(p_name) AS key, lower(p_type) AS kind, upper(p_name) AS name FROM part",
    "redacted_documents": f"SELECT doc_id, {redacted_sql('text')} AS text FROM documents",
    "redacted_records": f"""
SELECT event_id, '{{"event_id":' || event_id || ',"event_type":' || to_json({redacted_sql("event_type")}) || coalesce(',"note":' || to_json({redacted_sql("props")}), '') || ',"user_id":"{R.MARK}"}}' AS record FROM events""",
}

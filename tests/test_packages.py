"""Inventories, builds, resumption, verification and commands, end to end on small files."""

import hashlib
import json
import os
import zipfile
from pathlib import Path

import pytest

from foliospark import cli
from foliospark.operators import packaging as K
from foliospark.operators import verify as V
from foliospark.sources import files
from foliospark.sources.config import ConfigurationError, Project, load_config
from foliospark.sources.inventory import load, parse
from foliospark.streaming import journal as stream


def ref(root, path, content):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_bytes(content)
    return {"source_path": path, "filename": Path(path).name, "size_bytes": len(content), "sha256": hashlib.sha256(content).hexdigest().upper()}


def records(root):
    account = lambda i, company, status, cover: {"record_type": "account", "account_id": f"a{i}", "company_id": company, "company_name": f"Empresa {company}", "division_id": "d", "division_name": "Geral/1", "period": "2026-06", "account_code": "10", "account_name": "Caixa", "status": status, "cover": cover}
    attachment = lambda i, a, f: {"record_type": "attachment", "document_id": f"doc{i}", "account_id": a, **f}
    return [
        account(1, "c1", "completed", ref(root, "covers/1.txt", b"one")),
        account(2, "c1", "pending", None),
        account(3, "c2", "completed", ref(root, "covers/3.txt", b"three" * 1000)),
        account(4, "c3", "pending", None),
        attachment(1, "a1", ref(root, "x/nota.txt", b"first")),
        attachment(2, "a1", ref(root, "y/NOTA.TXT", b"second")),
        attachment(3, "a2", ref(root, "x/é.txt", b"third")),
    ]


def written(tmp_path, rows, master=True):
    (tmp_path / "inventory.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n", encoding="utf-8")
    (tmp_path / "config.toml").write_text(f'schema_version = 1\n[paths]\ninventory = "inventory.jsonl"\nsource_root = "src"\noutput_dir = "out"\n[build]\nmax_workers = 2\ncreate_master = {str(master).lower()}\n')
    return load_config(tmp_path / "config.toml")


@pytest.fixture
def project(tmp_path):
    (tmp_path / "out").mkdir()
    return written(tmp_path, records(tmp_path / "src"))


def test_inventory_is_decoded(spark, project):
    found = load(spark, str(project.inventory))
    assert found.accounts.count() == 4 and found.attachments.count() == 3
    assert found.violations.count() == 0
    assert found.sha256 == hashlib.sha256(project.inventory.read_bytes()).hexdigest()
    assert found.attachments.filter("document_id = 'doc1'").first().sha256 == hashlib.sha256(b"first").hexdigest()


BROKEN = [
    (lambda r: r[0].update(cover=None), "completed_without_cover", 1),
    (lambda r: r[1].update(cover=r[0]["cover"]), "pending_with_cover", 2),
    (lambda r: r[1].update(status="done"), "invalid_status", 2),
    (lambda r: r[4].update(record_type="memo"), "unknown_record_type", 5),
    (lambda r: r[2].update(period="2026-13"), "invalid_record", 3),
    (lambda r: r[4].update(extra=1), "invalid_record", 5),
    (lambda r: r[4].update(size_bytes=True), "invalid_record", 5),
    (lambda r: r[4].update(size_bytes=5.0), "invalid_record", 5),
    (lambda r: r[4].update(size_bytes="5"), "invalid_record", 5),
    (lambda r: r[4].update(sha256="0" * 63), "invalid_record", 5),
    (lambda r: r[0]["cover"].update(note="x"), "invalid_record", 1),
    (lambda r: r[3].update(account_id="a1"), "duplicate_account_id", 1),
    (lambda r: r[5].update(document_id="doc1"), "duplicate_document_id", 5),
    (lambda r: r[6].update(account_id="a9"), "orphan_attachment", 7),
]


def test_broken_records_are_told_by_rule_and_line(spark, tmp_path):
    """Each case alone in a copy of the inventory; those of one line are parsed in one go."""
    alone, expected = [], {}
    for i, (breaks, rule, line) in enumerate(BROKEN[:-3]):
        rows = records(tmp_path / "src")
        breaks(rows)
        alone += [(i * 100 + n, json.dumps(r, ensure_ascii=False).encode()) for n, r in enumerate(rows, 1)]
        expected[i * 100 + line] = rule
    found = parse(spark.createDataFrame(alone, "line_no int, line binary")).filter("diagnosis IS NOT NULL")
    assert {r.line_no: r.diagnosis for r in found.collect()} == expected


@pytest.mark.parametrize(("breaks", "rule", "line"), BROKEN[-3:])
def test_broken_references_are_told_by_rule_and_line(spark, tmp_path, breaks, rule, line):
    rows = records(tmp_path / "src")
    breaks(rows)
    first = load(spark, str(written(tmp_path, rows).inventory)).violations.orderBy("priority", "line_no").first()
    assert (first.rule, first.line_no) == (rule, line)


def test_lines_that_are_no_strict_json(spark):
    rows = [b'{"a":1,"a":2}', b"{", b'{"record_type":"account"} x', b"\xff\xfe", b" \t\r", b"[]"]
    found = parse(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "line_no int, line binary"))
    assert {r.line_no: r.diagnosis for r in found.collect()} == {0: "invalid_json", 1: "invalid_json", 2: "invalid_json", 3: "invalid_json", 5: "unknown_record_type"}


def test_an_empty_inventory_is_a_violation(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text("\n \n")
    assert [r.rule for r in load(spark, str(tmp_path / "i.jsonl")).violations.collect()] == ["no_records"]


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in sorted(Path(folder).rglob("*")) if p.is_file()}


def test_build_verifies_repeats_and_leaves_sources_alone(spark, project, tmp_path):
    before = tree(tmp_path / "src")
    inventory = load(spark, str(project.inventory))
    summary = K.build(spark, project, inventory)
    assert tree(tmp_path / "src") == before
    assert (summary["archive_count"], summary["member_count"], summary["master_created"]) == (3, 5, True)
    out = project.output_dir
    with zipfile.ZipFile(out / "Empresa c1 - Geral_1.zip") as z:
        assert z.namelist() == ["2026-06/10 - Caixa (2)/Anexos/é.txt", "2026-06/10 - Caixa/Anexos/NOTA (2).TXT", "2026-06/10 - Caixa/Anexos/nota.txt", "2026-06/10 - Caixa/Capa/1.txt", K.MANIFEST]
        manifest = json.loads(z.read(K.MANIFEST))
        assert [m["path"] for m in manifest["members"]] == z.namelist()[:-1]
    with zipfile.ZipFile(out / "Empresa c3 - Geral_1.zip") as z:
        assert z.namelist() == [K.MANIFEST]
    with zipfile.ZipFile(out / K.MASTER) as z:
        assert z.namelist()[:-1] == [f"Empresa c{i} - Geral_1.zip" for i in (1, 2, 3)]
    assert V.verify_job(spark, str(out), inventory) == {"valid": True, "archive_count": 3, "member_count": 5, "output_bytes": summary["output_bytes"], "issues": []}
    with pytest.raises(K.BuildError):
        K.build(spark, project, inventory)
    # Resumed as if it had stopped after the first archives: what is made anew has the same bytes, the rest is not touched.
    journal = out / K.JOURNAL
    lines = journal.read_bytes().splitlines(keepends=True)
    journal.write_bytes(b"".join(lines[:2]))
    made = {name: (out / name).read_bytes() for name in (K.SUMMARY, K.MASTER, "Empresa c3 - Geral_1.zip")}
    for name in made:
        (out / name).unlink()
    kept = (out / "Empresa c1 - Geral_1.zip").stat().st_mtime_ns
    assert K.build(spark, project, inventory, resume=True) == summary
    assert (out / "Empresa c1 - Geral_1.zip").stat().st_mtime_ns == kept
    assert {name: (out / name).read_bytes() for name in made} == made
    journal.write_bytes(journal.read_bytes()[:-3])
    with pytest.raises(K.BuildError):
        K.build(spark, project, inventory, resume=True)


def rewritten(path, change):
    with zipfile.ZipFile(path) as z:
        entries = [(i, z.read(i)) for i in z.infolist()]
    with zipfile.ZipFile(path, "w") as z:
        for info, data in change(entries):
            z.writestr(info, data)


TAMPER = {
    "content": lambda e: [(i, b"other" if "Capa" in i.filename else d) for i, d in e],
    "collision": lambda e: [(zipfile.ZipInfo(e[0][0].filename.upper()), b""), *e],
    "folder": lambda e: [(zipfile.ZipInfo("x/"), b""), *e],
    "manifest_first": lambda e: e[-1:] + e[:-1],
    "dropped": lambda e: e[1:],
}


def test_tampered_missing_and_linked_archives_do_not_verify(spark, project):
    inventory = load(spark, str(project.inventory))
    K.build(spark, Project(**{**project.__dict__, "create_master": False}), inventory)
    out = project.output_dir
    place = out / "Empresa c1 - Geral_1.zip"
    sound = place.read_bytes()
    for change in TAMPER.values():
        rewritten(place, change)
        found = V.verify_job(spark, str(out), inventory)
        assert not found["valid"] and found["member_count"] == 0 and len(found["issues"]) == 1
        place.write_bytes(sound)
    assert V.verify_job(spark, str(out), inventory)["valid"]
    place = out / "Empresa c2 - Geral_1.zip"
    moved = out / "moved"
    place.rename(moved)
    assert not V.verify_job(spark, str(out), inventory)["valid"]
    place.symlink_to(moved)
    assert not V.verify_job(spark, str(out), inventory)["valid"]


def test_a_source_that_changed_stops_a_build(spark, project, tmp_path):
    inventory = load(spark, str(project.inventory))
    (tmp_path / "src/covers/1.txt").write_bytes(b"two")
    with pytest.raises(Exception, match="not what the inventory declares"):
        K.build(spark, project, inventory)


def test_sources_are_inspected(spark, project, tmp_path):
    os.symlink("/etc/hostname", tmp_path / "src/link")
    rows = spark.createDataFrame([("covers/1.txt", 3, hashlib.sha256(b"one").hexdigest(), "a"), ("covers/1.txt", 4, "x", "b"), ("link", 1, "x", "c"), ("../x", 1, "x", "d"), ("covers/1.txt", 3, hashlib.sha256(b"one").hexdigest(), "e.pdf")], "source_path string, size_bytes long, sha256 string, member_path string")
    issues = {r.member_path: r.issue for r in files.inspect(rows, str(tmp_path / "src")).collect()}
    assert (issues["a"], issues["b"], issues["c"], issues["d"]) == (None, "content", "path", "path")
    assert issues["e.pdf"] in ("pdf", "pdf_unchecked")


@pytest.mark.parametrize("change", ["schema_version = 2", "[extra]", "[build]\npath_limit = 186", "[build]\npath_limit = true", "[build]\nmax_workers = 0"])
def test_settings_are_strict(tmp_path, change):
    base = 'schema_version = 1\n[paths]\ninventory = "i"\nsource_root = "s"\noutput_dir = "o"\n'
    text = base.replace("schema_version = 1", change) + "[build]\n" if change.startswith("schema") else base + (change if change.startswith("[build]") else change + "\n[build]\n")
    (tmp_path / "c.toml").write_text(text)
    with pytest.raises(ConfigurationError):
        load_config(tmp_path / "c.toml")
    (tmp_path / "c.toml").write_text(base + "[build]\n")
    assert load_config(tmp_path / "c.toml").inventory == tmp_path / "i"
    (tmp_path / "c.toml").write_text(base)
    with pytest.raises(ConfigurationError):
        load_config(tmp_path / "c.toml")


def test_commands(spark, project, tmp_path, capsys):
    config = str(tmp_path / "config.toml")

    def run(*args):
        code = cli.main([*args], spark)
        return code, json.loads(capsys.readouterr().out)

    assert run("preview", config)[0] == 0
    code, found = run("validate", config)
    assert code == 0 and found["status"] == "VALID" and found["member_count"] == 5
    assert run("verify", config)[0] == 3
    assert run("build", config)[0] == 0
    assert run("verify", config)[0] == 0
    assert run("preview", config)[0] == 3
    assert run("preview", str(tmp_path / "none.toml")) == (2, {"status": "INVALID_INPUT"})
    project.inventory.write_text("{}\n")
    assert run("preview", config) == (2, {"status": "INVALID_INPUT", "rule": "unknown_record_type", "line": 1})


def test_streams_of_events(spark, tmp_path):
    rows = [("j", 0, "START", None), ("j", 1, "ARCHIVE_VERIFIED", 0), ("j", 2, "ARCHIVE_VERIFIED", 0), ("j", 3, "COMPLETE", None), ("k", 4, "COMPLETE", None)]
    kind = "job string, event_id long, event string, archive_index long"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = stream.follow(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 1, False).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.job, r.event_id, r.rule) for r in spark.table("told").collect()} == {("j", 2, "index_repeated"), ("k", 4, "no_start")}


def test_windowed_totals_of_a_stream(spark, tmp_path):
    rows = [("j", "2026-01-01 01:00:00", 5), ("j", "2026-01-01 23:00:00", 7), ("j", "2026-01-02 00:30:00", 1), ("k", "2026-01-01 02:00:00", None)]
    made = spark.createDataFrame(rows, "job string, at string, size_bytes long").selectExpr("job", "cast(at as timestamp) as ts", "size_bytes")
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    told = stream.totals(spark.readStream.schema(made.schema).parquet(str(tmp_path / "in")), "ts")
    query = told.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.job, r.window.start.day, r.n_events, r.size_bytes) for r in spark.table("totals").collect()} == {("j", 1, 2, 12), ("j", 2, 1, 1), ("k", 1, 1, None)}

"""Scalar functions against values worked out by hand, at edges that the tables do not have."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import naming as N
from foliospark.functions import redaction as R
from foliospark.functions.canonical import canonical, is_strict_json, strict_object
from foliospark.functions.sizing import archive_bound, compressed_bound
from foliospark.operators import constraints as C


def values(spark, rows, column, kind="string"):
    return [r.out for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").select("i", column.alias("out")).orderBy("i").collect()]


SAFE = {
    "CON": "_CON", "aux.txt": "_aux.txt", "Lpt9.": "_Lpt9", "COM10": "COM10", "  account name.  ": "account name", "Alpha?Beta": "Alpha_Beta", "Cafe\u0301": "Café", "...   ": "_",
    "a\x01b": "a_b", "conin$.x": "_conin$.x", "COM¹": "_COM¹", "\u00a0x\u00a0": "x", "": "_", "nul .txt": "_nul .txt",
}


def test_safe_components(spark):
    assert values(spark, list(SAFE), N.safe_component(F.col("x"))) == list(SAFE.values())


def test_ascii_path_agrees_with_the_unicode_one(spark):
    rows = [x for x in SAFE if x.isascii()]
    assert values(spark, rows, N.safe_component(F.col("x"), ascii_only=True)) == [SAFE[x] for x in rows]


def test_keys_fold_case_and_width(spark):
    assert values(spark, ["Straße", "ＡＢＣ", "ﬁ", None], N.folded(F.col("x"))) == ["strasse", "abc", "fi", None]


def test_utf16(spark):
    assert values(spark, ["💼a", "abc", "", None], N.utf16_units(F.col("x"))) == [3, 3, 0, None]
    assert values(spark, ["💼ab", "abc", "a💼", "é"], N.truncate_utf16(F.col("x"), F.lit(2))) == ["💼", "ab", "a", "é"]
    assert values(spark, ["abc"], N.truncate_utf16(F.col("x"), F.lit(0))) == [""]


def test_suffixes(spark):
    rows = ["a.pdf", ".pdf", "..pdf", "a. b", "a", "a.b.c", "a."]
    assert values(spark, rows, N.suffix_of(F.col("x"))) == [".pdf", "", ".pdf", ". b", "", ".c", ""]
    assert values(spark, rows, N.stem_of(F.col("x"))) == ["a", ".pdf", ".", "a", "a", "a.b", "a."]
    assert values(spark, ["a (2)", "a (2) (3)", "a(2)"], N.without_number(F.col("x"))) == ["a", "a (2)", "a(2)"]


def test_bounds_of_the_demo(spark):
    sizes = spark.createDataFrame([(612,), (615,), (614,)], "x long")
    assert [r[0] for r in sizes.select(compressed_bound(F.col("x"))).collect()] == [681, 684, 683]
    assert sizes.agg(archive_bound(F.count("*"), F.sum(compressed_bound(F.col("x"))))).first()[0] == 55296
    assert values(spark, [0, 16384, 16385], compressed_bound(F.col("x")), "long") == [64, 16384 + 5 + 64, 16385 + 10 + 64]


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', '{"a":1} x', "[1", "", '{"a":{"b":1,"b":2}}'])
def test_strict_json_refuses(spark, text):
    assert values(spark, [text], is_strict_json(F.col("x"))) == [False]
    with pytest.raises(ValueError):
        strict_object(text)


def test_canonical_json():
    assert canonical({"b": None, "a": "é/"}) == '{"a":"é/","b":null}'.encode()


PATHS = {"a/b.pdf": None, "../a": "segment", "a/../b": "segment", "/a": "absolute", "C:/a": "colon", "C:a": "colon", "\\\\x\\y": "backslash", "a\\b": "backslash", "": "empty", ".": "segment", "a//b": "segment", "a\x00": "nul", None: "empty"}


def test_source_paths(spark):
    assert values(spark, list(PATHS), C.path_violation(F.col("x"))) == list(PATHS.values())


RECORD = {
    "account_name": "Ana", "name": "x", "filename": "y", "nested": {"source_path": "/a/b", "note": "mail ana@example.com"}, "member_count": 3, "archive_index": 0,
    "plan_sha256": "0123456789abcdef" * 4, "job_id": "0123456789abcdef" * 2, "list": ["CPF 123.456.789-09", "CNPJ 12.345.678/0001-95", "tel 11 91234-5678"],
    "text": "see C:\\Users\\ana\\x.txt", "secret note": "password = hunter2; token: abc", "web": "at https://example.com/x and /home/ana/y",
}


def test_records_are_redacted():
    found = R.redact(RECORD)
    assert [found[k] for k in ("account_name", "name", "filename")] == [R.MARK] * 3
    assert found["nested"] == {"source_path": R.MARK, "note": f"mail {R.MARK}"}
    assert [found[k] for k in ("member_count", "archive_index", "plan_sha256", "job_id")] == [3, 0, RECORD["plan_sha256"], RECORD["job_id"]]
    assert found["list"] == [f"CPF {R.MARK}", f"CNPJ {R.MARK}", f"tel {R.MARK}"]
    assert found["text"] == f"see {R.MARK}"
    assert found["secret note"] == f"password = {R.MARK}; token: {R.MARK}"
    assert found["web"] == f"at {R.MARK} and {R.MARK}"


def test_depth_is_no_matter():
    deep: object = "mail a@b.co"
    for _ in range(20_000):
        deep = [deep]
    found, kept = R.redact({"x": deep, "plan_sha256": "g" * 64, "job_id": ["a@b.co"]}), deep
    assert found["job_id"] == [R.MARK] and found["plan_sha256"] == "g" * 64
    found = found["x"]
    while isinstance(found, list):
        found, kept = found[0], kept[0]
    assert (found, kept) == (f"mail {R.MARK}", "mail a@b.co")


def test_column_and_record_forms_redact_alike(spark):
    texts = ["mail a.b@c.org now", "call (11) 91234-5678", "Bearer abcdef123456", "x=\\\\host\\share\\f", "api_key: 'a b', next", "card 1234-5678", "nothing", "id 12345678901", "/tmp/a/b c", "é123.456.789-09"]
    assert values(spark, texts, R.redacted(F.col("x"))) == [R.redact(t) for t in texts]


def test_json_records(spark):
    assert values(spark, ['{"email":"a@b.co","n":1}', "no json", None], R.redact_json(F.col("x"))) == ['{"email":"[REDACTED]","n":1}', None, None]


def test_field_names(spark):
    rows = ["E-Mail", "accountName", "user name", "plan_sha256", "TOKEN", "tokens"]
    assert values(spark, rows, R.sensitive_field(F.col("x"))) == [True, False, True, False, True, False] == [R.redact({x: 1})[x] == R.MARK for x in rows]

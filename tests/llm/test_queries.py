import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from foliospark.llm import copies, quality
from foliospark.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import SF, same
from .test_native import WORD, filled, without_boilerplate
from .test_simhash import roots, shingles


def mixed(rows):
    """How often each id comes: the rate's whole part, and once more if its md5 says so."""
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len(WORD.findall(text))
    rates = {s: t / sizes[s] if sizes[s] else 0 for s, t in filled(sizes).items()}
    chance = lambda key: int(hashlib.md5(f"mix-1\x1f{key}".encode()).hexdigest()[:13], 16) / 2**52
    return {i: int(rates[s]) + (chance(i) < rates[s] - int(rates[s])) for i, s, _ in rows}



@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert same(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_over_the_whole_table(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert QUERIES[name](spark, SF).count() == n or name == "op2_fuzzy_passages"


def test_mixed_words_come_near_targets(spark):
    found = QUERIES["op3_mixing"](spark, SF.replace("0.001", "0.01")).collect()
    assert all(r.taken <= 2 * r.size for r in found)
    assert abs(sum(r.taken for r in found) - 1.5 * sum(r.size for r in found)) < 0.1 * sum(r.size for r in found)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, SF).cache()
        if i < 4:
            assert docs.columns == columns
        rows, old = docs.collect(), before.collect()
        if i == 0:
            want = {r.doc_id: quality.judge(r.text)["cleaned"] for r in old if quality.judge(r.text)["kept"]}
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
        if i == 1:
            want = without_boilerplate([(r.source, r.text) for r in old], corpus_pipeline.LINE_RATIO, corpus_pipeline.LEAST_DOCUMENTS)
            assert {r.doc_id: r.text for r in rows} == {r.doc_id: text for r, (text, _) in zip(old, want, strict=True)}
        if i == 3:
            assert Counter(r.doc_id for r in rows) == Counter(mixed([(r.doc_id, r.source, r.text) for r in old]))
            texts = {r.doc_id: r.text for r in old}
            assert all(r.text == texts[r.doc_id] for r in rows)
        if i == 2:
            sets = [shingles(r.text) for r in old]
            links = [(old[i].doc_id, old[j].doc_id) for i in range(len(sets)) for j in range(i) if (both := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - both)]
            assert {r.doc_id for r in rows} == {i for i, root in roots([r.doc_id for r in old], links).items() if i == root}
            digests = [copies.sketch(r.text)[0] for r in rows]
            assert len(set(digests)) == len(digests) and {copies.sketch(r.text)[0] for r in old} >= set(digests)
        if i == 4:
            texts = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in old}
            assert len(rows) == len(old) and all(r.decoded_sha256 == texts[r.doc_id] and len(r.ids) == r.n_tokens for r in rows)


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0

import random
import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from foliospark.llm import copies, simhash
from foliospark.llm.components import components
from foliospark.llm.simhash import masks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    rng = random.Random(radius)
    tables = masks(radius)
    assert len(tables) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        flipped = sum(1 << i for i in rng.sample(range(64), radius))
        assert any(not flipped & m for m in tables)


def test_fingerprints_by_the_definition(spark):
    texts = ["", None, "one", "Two words", "A b C d", "É é x y z", "a b c\x0bd\x1ce f", "the same the same the same the same", "w " * 70_000, "\n\t "]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(rows, 3).collect()} == {i: fingerprint(t) for i, t in enumerate(texts)}


def clusters(rng):
    """Fingerprints in chains, a dense ball and at random, so that links of 1 and 2 bits and near misses all occur."""
    out = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            out.add(x)
            for i in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << i
    ball = rng.getrandbits(64)
    out |= {ball ^ sum(1 << i for i in rng.sample(range(64), 3)) for _ in range(300)}
    return sorted(out)


@pytest.mark.parametrize("radius", [1, 2])
def test_links_connect_what_pairs_connect(spark, radius):
    fps = [simhash.signed(x) for x in clusters(random.Random(5))]
    values = np.array(fps, dtype=np.int64).view(np.uint64)
    linked = [(fps[i], fps[i + 1 + j]) for i in range(len(fps)) for j in np.nonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius)[0]]
    want = roots(fps, linked)
    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius)).collect()}
    assert {x: found.get(x, x) for x in fps} == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_with_nulls_and_repeats(spark):
    rows = [(5, ""), (3, None), (None, ""), (9, "some text of five words"), (8, "SOME text of five words"), (8, "SOME text of five words"), (None, "lonely words stand here alone")]
    found = simhash.near_groups(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string"))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found.collect()) == [(-1, -1), (-1, 3), (3, 3), (5, 3), (8, 8), (8, 8), (9, 8)]
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingles(text):
    words = simhash.words_of(text)
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {b""}


def corpus(rng):
    vocabulary = [f"{a}{b}{c}" for a in ("th", "an", "er", "re") for b in ("on", "in", "ed", "es") for c in ("ing", "tion", "ly", "", "ment")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(50, 900))) for _ in range(60)]
    shared = " ".join(rng.choices(vocabulary, k=60))
    out = []
    for text in texts:
        out.append(text)
        for _ in range(rng.randrange(0, 5)):
            words = text.split(" ")
            for _ in range(rng.randrange(0, max(1, len(words) // 50))):
                words[rng.randrange(len(words))] = "changed" + str(rng.random())
            out.append(" ".join(words))
        out.append(shared + " " + " ".join(rng.choices(vocabulary, k=100)))
    return [*out, "", None, "  "]


def test_one_text_of_each_group_of_near_copies_stays(spark):
    """Against all pairs."""
    texts = corpus(random.Random(11))
    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if (both := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - both)]
    want = {i for i, root in roots(range(len(texts)), linked).items() if i == root}
    kept = {r.doc_id for r in copies.without_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == want


def test_repeated_rows_and_other_columns(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "a b c", "x"), (2, "A B  c", "y"), (None, "other words", "z"), (None, "other words", "z"), (1, "third text", "w")]
    found = copies.without_copies(spark.createDataFrame(rows, "doc_id long, text string, node string"))
    assert found.columns == ["doc_id", "text", "node"]
    names = ["n", "stays", "__bucket", "__bits", "id", "key", "order", "maybe", "row", "root", "fp"]
    more = copies.without_copies(spark.createDataFrame(rows, "doc_id long, text string, node string").select("*", *(F.lit("mine").alias(n) for n in names)))
    assert sorted((r.doc_id or 0, r.node) for r in more.filter(" AND ".join(f"`{n}` = 'mine'" for n in names)).collect()) == [(0, "z"), (1, "w"), (1, "x")]
    assert sorted((r.doc_id or 0, r.node) for r in found.collect()) == [(0, "z"), (1, "w"), (1, "x")]
    assert copies.without_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_of_all_texts_are_counted(spark):
    rng = random.Random(35)
    usual = " ".join(f"usual{i}" for i in range(9))
    texts = [" ".join(f"w{rng.random()}" for _ in range(20)) + " " + usual for _ in range(400)] + [usual, None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    counts = copies.shingle_counts(rows)
    exact = {}
    for t in texts:
        for h in copies.shingles_of(simhash.words_of(t)).tolist():
            exact[h] = exact.get(h, 0) + 1
    h = copies.np.array(list(exact), dtype="<u8")
    found = copies.np.take_along_axis(counts, copies.places(h), axis=1).min(axis=0)
    told = copies.np.round(1000 * copies.np.log2(1 + copies.np.array(list(exact.values()))))
    assert (found >= told).all() and (found == told).mean() > 0.99
    assert copies.prefix(h, counts).tolist() == sorted(h.tolist(), key=lambda x: (found[h.tolist().index(x)], x))[: len(h) // 5 + 1]
    assert (copies.shingle_counts(rows.limit(0)) == 0).all()


def test_parities_rule_out_no_similar_pair(spark):
    rng, sets = random.Random(34), []
    for n in [0, 1, 5, 60, 63, 64, 65, 120, 130, 300, 2000] * 6:
        base = [rng.getrandbits(64) for _ in range(n)]
        for part in (0.05, 0.1, 0.15, 0.3):
            sets.append((base, [rng.getrandbits(64) if rng.random() < part else x for x in base][: n - rng.randrange(n // 8 + 1)]))
    as_array = lambda x: copies.np.unique(copies.np.array(x, dtype="<u8"))
    nodes, agree = [], {}
    for i, (x, y) in enumerate(sets):
        nodes += [(2 * i, len(set(x)), copies.parities(as_array(x)).tolist()), (2 * i + 1, len(set(y)), copies.parities(as_array(y)).tolist())]
        agree[2 * i] = len({*x} & {*y}) / max(1, len({*x} | {*y}))
    found = copies.plausible(spark.createDataFrame([(i, i + 1) for i in agree], "a long, b long"), spark.createDataFrame(nodes, "node long, n long, odd array<long>"))
    passed = {r.a for r in found.collect()}
    for x, y in sets:
        few = [copies.parities(as_array(z), copies.FEW) for z in (x, y)]
        assert all(len(f) <= copies.FEW for f in few) and (len(x) < 2000 or len(few[0]) == copies.FEW)
    assert passed >= {i for i, j in agree.items() if j >= 0.8}
    assert not [i for i in passed if agree[i] < 0.7 and len(sets[i // 2][0]) >= 60]


def test_close_simhashes_are_the_first_candidates(spark):
    rng = random.Random(33)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in fps for _ in range(3)] + fps[:5]
    nodes = [(rng.getrandbits(62), simhash.signed(x)) for x in fps]
    found = {(r.a, r.b) for r in copies.close(spark.createDataFrame(nodes, "node long, fp long")).collect()}
    near = [(a, b) for i, (a, x) in enumerate(nodes) for b, y in nodes[:i] if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2]
    assert all(a < b for a, b in found) and roots([n for n, _ in nodes], found) == roots([n for n, _ in nodes], near)


def edited(rng, words, places):
    """The words with others at so many places, one in each stretch between them."""
    out, step = list(words), len(words) // places
    for i in range(places):
        out[i * step + rng.randrange(5, step - 5)] = "changed" + str(rng.random())
    return out


def kept_by_all_pairs(texts):
    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if (both := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - both)]
    return {i for i, root in roots(range(len(texts)), linked).items() if i == root}


def test_copies_that_only_the_original_links_are_all_found(spark):
    rng = random.Random(21)
    words = [f"w{rng.random()}" for _ in range(150)]
    texts = [" ".join(edited(rng, words, 2)) for _ in range(300)]
    texts.insert(150, " ".join(words))
    want = kept_by_all_pairs(texts)
    kept = {r.doc_id for r in copies.without_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == want


def test_short_texts_with_one_changed_word_are_copies(spark):
    rng, texts = random.Random(22), []
    for n in [52, 60] * 60:
        words = [f"w{rng.random()}" for _ in range(n)]
        texts += [" ".join(words), " ".join(edited(rng, words, 1))]
    kept = {r.doc_id for r in copies.without_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == kept_by_all_pairs(texts)

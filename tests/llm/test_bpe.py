import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from foliospark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
VOCABULARY = bpe.Vocabulary(RANKS)
TEXTS = ["", None, "a", " ", "\n\n  x", "The quick brown fox's 123 éàü 💼   \x1c\x1d", "thndention " * 50, "x" * 5000, " " * 3000 + "a", "日本語のテキスト" * 200, "<|endoftext|>", "ab́", "THAT!! " * 20, "퟿"]


def merged(raw):
    """Plain merging: the pair of lowest rank first, the leftmost of equal ones."""
    parts = [bytes([b]) for b in raw]
    while len(parts) > 1:
        rank, i = min((RANKS.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [RANKS[p] for p in parts]


def some_bytes(rng, n):
    return bytes(rng.choice(b"aaabbcdeinorst  \xc3\xa9\n.") for _ in range(n))


def test_prefix_table_is_plain_merging():
    rng = random.Random(1)
    for _ in range(300):
        raw = some_bytes(rng, rng.randrange(1, 60))
        table = bpe.PrefixTable(VOCABULARY, raw)
        assert table.tokens() == merged(raw)
        for end in (1, len(raw) // 2 + 1, len(raw)):
            assert VOCABULARY.bytes_of[table.last[end]] == VOCABULARY.bytes_of[merged(raw[:end])[-1]]


def test_appends_and_edits_are_exact():
    rng = random.Random(2)
    for _ in range(200):
        raw = some_bytes(rng, rng.randrange(0, 400))
        table = bpe.PrefixTable(VOCABULARY, raw)
        i = rng.randrange(len(raw) + 1)
        j = rng.randrange(i, len(raw) + 1)
        new = some_bytes(rng, rng.randrange(0, 12))
        table.replace(i, j, new)
        raw = raw[:i] + new + raw[j:]
        table.append(more := some_bytes(rng, 5))
        raw += more
        assert table.content == raw and table.last == bpe.PrefixTable(VOCABULARY, raw).last


def test_an_edit_is_local():
    table = bpe.PrefixTable(VOCABULARY, b"the cat sat on the mat. " * 400)
    assert table.replace(4800, 4803, b"dog") < 400


def test_codec_agrees_with_tiktoken():
    codec = bpe.Codec(VOCABULARY, public_tokenizers.PATTERN)
    for text in TEXTS:
        ids = codec.encode(text or "")
        assert ids == REFERENCE.encode_ordinary(text or "")
        assert codec.decode(ids) == (text or "").encode()


def test_rows(spark):
    rows = [(i, t, "kept") for i, t in enumerate(TEXTS)] + [(None, "a", None)]
    found = bpe.encode_texts(spark.createDataFrame(rows, "doc_id long, text string, N_Tokens string"), PATH, public_tokenizers.PATTERN).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = REFERENCE.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_texts(spark.createDataFrame([], "text string"), PATH, public_tokenizers.PATTERN).count() == 0


def test_a_vocabulary_that_lacks_a_byte_is_told():
    with pytest.raises(ValueError):
        bpe.PrefixTable(bpe.Vocabulary({b"a": 0}), b"b")

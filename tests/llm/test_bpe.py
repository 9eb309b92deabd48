import base64
import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from barloom.llm import bpe, queries  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    random.seed(3)
    some = list("ab ZéÉ'sdt0129  \n\t\r\x0b\x1c\x85  　!?.,#́漢字🙂\0\1")
    out = ["".join(random.choices(some, k=random.randint(0, 80))) for _ in range(400)]
    return [*out, "", " ", "a" * 3000, "ab" * 1500, "é" * 400, " " * 300, "it's  two\n\n lines ", "<|endoftext|>", *["same text here"] * 3]


def test_same_as_the_library(reference):
    coder = bpe.load(RANKS, public_tokenizers.PATTERN)
    own = texts()
    ids, n = coder.encode(own)
    lo = 0
    for t, k in zip(own, n):
        assert ids[lo : lo + k].tolist() == reference.encode_ordinary(t)
        lo += k
    data, _ = coder.decode(ids, n)
    assert data.tobytes() == "".join(own).encode()


def test_long_pretokens_round_by_round(reference, monkeypatch):
    random.seed(5)
    coder = bpe.load(RANKS, public_tokenizers.PATTERN)
    own = ["".join(random.choices(s, k=random.randint(129, 900))) for s in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "=-", "éa") for _ in range(12)]
    own += ["t" * 200_000, "".join(random.choices("etaoinshrdlu", k=60_000)), "abcabd" * 9000]
    rounds = []
    find = coder.pairs.find
    monkeypatch.setattr(coder.pairs, "find", lambda a, b: rounds.append(len(a)) or find(a, b))
    for t in own:
        got = coder.merge_wide(t.encode()).tolist()
        assert got == reference._encode_single_piece(t.encode())
    assert len(rounds) > len(own)


def test_another_pattern(reference):
    pattern = r"\p{L}+ \p{L}+|.|\n"
    other = tiktoken.Encoding("two", pat_str=pattern, mergeable_ranks=reference._mergeable_ranks, special_tokens={})
    coder = bpe.ByteBPE(RANKS, pattern)
    own = ["one two three four", "a b\nc d", " lead", ""]
    ids, n = coder.encode(own)
    assert ids.tolist() == [i for t in own for i in other.encode_ordinary(t)] and len(n) == 4


def test_query(docs, save, reference):
    own = [*texts(), None]
    rows = queries.op5_bpe(docs(own).sparkSession, save(documents=docs(own, extra=True))).collect()
    assert len(rows) == len(own)
    for r in rows:
        t = own[r.doc_id] or ""
        ids = reference.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_empty_table(docs, save):
    assert queries.op5_bpe(docs([]).sparkSession, save(documents=docs([]))).count() == 0

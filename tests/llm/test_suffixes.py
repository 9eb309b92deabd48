import hashlib
import random

import numpy as np
import pytest

from barloom.llm import queries, suffixes


def test_suffix_array_sorts_by_depth():
    random.seed(4)
    for _ in range(300):
        text = np.array([random.choice([0, 1, 1, 2, 255]) for _ in range(random.randint(0, 60))], np.int16)
        data = text.astype(np.uint8).tobytes()
        for depth in (3, 100):
            order = suffixes.suffix_array(text, depth).tolist()
            assert sorted(order) == list(range(len(data)))
            keys = [data[i : i + depth] for i in order]
            assert keys == sorted(keys)
            got = suffixes.common_prefixes(text, np.array(order, np.int64), depth)
            for k, (a, b) in enumerate(zip(keys, keys[1:])):
                n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert got[k] == n


def brute(rows, window):
    seen = {}
    cut = [(t or "").encode() for _, t in rows]
    for w in cut:
        for k in range(len(w) - window + 1):
            key = w[k : k + window]
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (d, _), w in zip(rows, cut):
        gone = np.zeros(len(w) + 1, bool)
        for k in range(len(w) - window + 1):
            if seen[w[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((d, len(w), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(window, n=90, seed=3):
    random.seed(seed)
    line = lambda k: "".join(random.choice("abcdé \n\0") for _ in range(k))
    shared = [line(random.choice([window - 1, window, window + 1, 2 * window, 5 * window])) for _ in range(6)]
    texts = ["".join(random.choice(shared) if random.random() < 0.4 else line(random.randint(0, window)) for _ in range(random.randint(0, 4))) for _ in range(n)]
    return [*texts, *[shared[0] * 3] * 3, "a" * (3 * window), "ab" * window, "", None, "b" * (window - 1), "c" * window, "d" * (window + 1)]


@pytest.mark.parametrize("window,seed,limit", [(40, 8, 4000), (40, 8, 3), (400, 32, 4000), (400, 32, 2)])
def test_same_as_brute_force(docs, window, seed, limit):
    texts = corpus(window)
    got = suffixes.digest(suffixes.remove_repeats(docs(texts, extra=True), window=window, seed=seed, limit=limit))
    assert sorted(tuple(r) for r in got.collect()) == brute(list(enumerate(texts)), window)


@pytest.mark.parametrize("limit", [50, 8])
def test_common_passage_in_other_surroundings(docs, limit):
    """A passage shorter than the window in many texts, two of which also share what surrounds it; and long texts."""
    random.seed(8)
    line = lambda k: "".join(random.choice("abcdefgh ") for _ in range(k))
    passage, around = line(300), line(90)
    texts = [line(random.randint(150, 300)) + passage + line(random.randint(150, 300)) for _ in range(70)]
    texts += [line(200) + around + passage + around + line(100) for _ in range(2)] + [passage + line(20) + passage + line(380) + passage]
    texts += [(long := line(60_000)), long[5000:30_000] + line(10)]
    got = suffixes.digest(suffixes.remove_repeats(docs(texts), limit=limit))
    assert sorted(tuple(r) for r in got.collect()) == brute(list(enumerate(texts)), 400)


def test_further_keys_depend_on_the_window_alone():
    random.seed(2)
    body = bytes(random.randrange(4) for _ in range(600))
    keys = suffixes.further_keys(body, 40, 8)
    assert len(keys) == 561 and all(keys[i] == suffixes.further_keys(body[i : i + 40], 40, 8)[0] for i in range(0, 561, 37))


def test_query(docs, save):
    texts = corpus(400, 20)
    rows = queries.op3_suffixes(docs(texts).sparkSession, save(documents=docs(texts))).collect()
    assert sorted(tuple(r) for r in rows) == brute(list(enumerate(texts)), 400)
    assert queries.op3_suffixes(docs([]).sparkSession, save(documents=docs([]))).count() == 0


def test_repeated_ids(docs):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(200))
    got = suffixes.remove_repeats(docs([text, text, "x" + text, "y"], [5, 5, None, 6])).collect()
    assert sorted((r.doc_id is None, r.n_removed > 0) for r in got) == [(False, False), (False, True), (False, True), (True, False)]

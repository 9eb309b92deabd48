import re
from collections import Counter

import pytest

from barloom.llm import quality, queries

TEXTS = [
    None,
    "",
    " \t\n",
    "one two",
    "a b c a b c",
    "a a a a",
    "a b c x a b c y b c x",
    "line one\nline one\n\nline two\n \nline one",
    "# a*b $c %d &e |f <g>",
    " ".join(f"the word{i} of" for i in range(60)),
    " ".join(["the same words again and"] * 40),
    " ".join(f"w{i % 977} of x{i % 31}" for i in range(30_000)),
    "x" * 100_000,
]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    k = Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(len(w) - 2) if k[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures(docs, save):
    df = docs(TEXTS, extra=True)
    for r in queries.op6_quality(df.sparkSession, save(documents=df)).collect():
        own = brute(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own, r.doc_id
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (r.base_failed and r.kept)


def test_rules_name_what_is_broken(docs):
    good = " ".join(f"the plain{chr(97 + i % 26)}{chr(97 + i // 26)} of" for i in range(80))
    rows = {r.doc_id: r for r in quality.judge(docs([good, good.replace(" of", " of###"), good.upper()])).collect()}
    assert rows[0].kept and not rows[0].broken
    assert "symbols" in rows[1].broken and not rows[1].kept
    assert "shouting" in rows[2].broken


@pytest.mark.parametrize("texts", [[], [None]])
def test_nothing(docs, texts):
    assert [r.kept for r in quality.judge(docs(texts)).collect()] == [False] * len(texts)

import random
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import langid, queries

SYLLABLES = {"aa": "ka lo mi tu pe sa ri no".split(), "bb": "sch ung ein ver ach ich keit ber".split(), "cc": "eau oux ent que les ère ité ons".split()}


def prose(lang, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def table(docs, rows):
    from pyspark.sql import types as T

    df = docs([t for t, _ in rows], extra=True)
    langs = df.sparkSession.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("l", T.StringType())]))
    return df.join(langs, "doc_id").withColumn("lang", F.col("l")).drop("l")


ROWS = [(prose(x, 5 + 37 * i % 200, f"{x}{i}"), x) for i in range(60) for x in SYLLABLES]
ODD = [(None, "aa"), ("", "bb"), (" \t\n", None), ("12 34 ...", "cc"), (prose("bb", 60_000, 9), None), (ROWS[0][0], "aa"), (ROWS[0][0], "aa")]


def test_query(docs, save):
    rows = ROWS + ODD
    df = table(docs, rows)
    got = {r.doc_id: r for r in queries.op13_langid(df.sparkSession, save(documents=df)).collect()}
    assert len(got) == len(rows)
    for i, (text, lang) in enumerate(rows):
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0) and r.rejected
        elif lang and r.held_out:
            assert r.lang_pred == lang
    assert got[len(ROWS) + 4].lang_pred == "bb"


def test_labels_of_held_out_rows_are_not_read(docs, save):
    df = table(docs, ROWS)
    wrong = df.withColumn("lang", F.when(langid.fold() == 2, F.lit("zz")).otherwise(F.col("lang")))
    one, two = ({r.doc_id: (r.lang_pred, r.score) for r in queries.op13_langid(df.sparkSession, save(documents=x)).collect()} for x in (df, wrong))
    assert one == two and "zz" not in {p for p, _ in one.values()}


def test_smallest_encoding_wins_by_a_plain_loop(docs):
    df = table(docs, ROWS + ODD)
    profiles = langid.train(df)
    assert set(profiles.languages) == set(SYLLABLES) and all(len(d) <= langid.DICTIONARY for d in profiles.dictionaries)
    coders = langid.compressors(profiles)
    for r in langid.identify(df, profiles, keep=("text",)).collect():
        if r.lang_pred != "und":
            s = langid.sizes(r.text, coders)
            assert profiles.languages[s.index(min(s))] == r.lang_pred
            assert r.margin == pytest.approx((sorted(s)[1] - min(s)) / min(s)) and r.rejected == (r.margin < 0.02)


def test_mixed_text_is_rejected(docs):
    df = table(docs, ROWS)
    profiles = langid.train(df)
    clear = langid.identify(docs([prose("aa", 80, 1), prose("bb", 80, 2)]), profiles)
    assert not any(r.rejected for r in clear.collect())
    assert all(r.rejected for r in langid.identify(docs(["x", "qqqq zzzz"]), profiles).collect())


@pytest.mark.parametrize("rows", [[], [(None, None)], [("abc", None)], [("abc", "aa")]])
def test_little_or_nothing(docs, rows, save):
    df = table(docs, rows)
    profiles = langid.train(df)
    got = langid.identify(df, profiles).collect()
    assert [r.lang_pred for r in got] == ["aa" if rows == [("abc", "aa")] else "und"] * len(rows)


def test_repeats_and_case():
    assert langid.normalised("Der Der DER, der  Tag! Der1") == b"der tag der"

"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Measures come from the whole text. A rule that a text breaks is named in ``broken``; a text is kept
if its base measures hold and it breaks no rule. Null and empty texts have no words and fail.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, for a character class.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: Frequent short words of four languages.
STOP_WORDS = (
    "the of and to in is that it for on was be with as by this are at from or "
    "der die und das von den zu mit ist nicht auf im ein eine "
    "de la le les et des en un une que qui du est pour dans par sur pas "
    "el los las y del se por con para al es su lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure per unit and the range that it must be in."""

    name: str
    measure: str
    per: str | None = None
    least: float | None = None
    most: float | None = None


#: The default thresholds; a ratio over nothing counts as 0.
RULES = (
    Rule("words", "n_words", least=50),
    Rule("words_long", "n_words", most=100_000),
    Rule("word_length", "word_chars", "n_words", least=3.0, most=10.0),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("alphabetic", "n_alpha_words", "n_words", least=0.8),
    Rule("stop_words", "n_stop_words", least=2),
    Rule("stop_word_share", "n_stop_words", "n_words", least=0.02),
    Rule("shouting", "n_shouts", "n_words", most=0.1),
    Rule("repeated_words", "n_repeat_words", "n_words", most=0.4),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.3),
    Rule("bullets", "n_bullets", "n_lines", most=0.9),
    Rule("ellipses", "n_ellipses", "n_lines", most=0.3),
)


def repeat_words(words: Column) -> Column:
    """Words within 3-word windows that are found twice or more in an array of words.

    Windows are sorted by a key of their hash's upper bits and their place in its lower bits, so that
    equal windows are neighbours; neighbours count as equal if the hashes of all three words agree.
    """
    n = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    at = lambda h, i: F.get(h, i)

    def covered(h: Column, bits: Column) -> Column:
        low = F.pow(F.lit(2.0), bits).cast("long") - 1
        keys = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(h, i), at(h, i + 1), at(h, i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))

        def flagged(s: Column) -> Column:
            place = lambda k: k.bitwiseAND(low).cast("int")
            near = lambda a, b: (a.bitwiseXOR(b) <= low) & (a.bitwiseXOR(b) >= 0)
            same = lambda a, b: near(a, b) & (at(h, place(a)) == at(h, place(b))) & (at(h, place(a) + 1) == at(h, place(b) + 1)) & (at(h, place(a) + 2) == at(h, place(b) + 2))
            own = F.transform(s, lambda k, j: F.when(F.coalesce(same(k, F.get(s, j + 1)), F.lit(False)) | F.coalesce(same(k, F.get(s, j - 1)), F.lit(False)), place(k)))
            return F.sort_array(F.filter(own, lambda p: p.isNotNull()))

        def length(p: Column) -> Column:
            gaps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))).cast("long"))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)

        return _let(_let(keys, flagged), length)

    bits = F.ceil(F.log2(n + 1)).cast("int") + 1
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(_let(hashes, lambda h: covered(h, bits)))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the measures of each whole text; other columns are dropped, repeated rows stay."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    own = own.select("doc_id", "_t", F.filter(F.split("_t", f"[{SPACE}]+"), lambda w: w != "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("_l"))
    n = lambda c: c.cast("long")
    lower = F.transform("_w", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")))
    return own.select(
        "doc_id",
        n(F.size("_w")).alias("n_words"),
        n(F.length(F.array_join("_w", ""))).alias("word_chars"),
        n(F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]", ""))).alias("n_symbols"),
        n(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        n(F.size("_l")).alias("n_lines"),
        n(F.size(F.filter(lower, lambda w: F.array_contains(stop, w)))).alias("n_stop_words"),
        n(F.size(F.filter("_w", lambda w: F.lower(w) != F.upper(w)))).alias("n_alpha_words"),
        n(F.size(F.filter("_w", lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))))).alias("n_shouts"),
        n(F.size(F.filter("_l", lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•")))).alias("n_bullets"),
        n(F.size(F.filter("_l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))).alias("n_ellipses"),
    )


def broken(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of measures breaks."""
    out = []
    for r in rules:
        value = F.col(r.measure).cast("double")
        if r.per:
            value = F.when(F.col(r.per) > 0, value / F.col(r.per)).otherwise(F.lit(0.0))
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (value < r.least)
        if r.most is not None:
            bad = bad | (value > r.most)
        out.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*out))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The measures of each document, base_failed, kept and the names of broken rules."""
    m = measures(docs, text)
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    m = m.select("*", failed.alias("base_failed"), broken(rules).alias("broken"))
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB SQL."""
    ws = "[\\x20\\x09-\\x0D]"
    bad = []
    for r in rules:
        value = f"(CASE WHEN {r.per} > 0 THEN {r.measure}::DOUBLE / {r.per} ELSE 0 END)" if r.per else f"{r.measure}::DOUBLE"
        bad += [f"{value} < {r.least}::DOUBLE"] * (r.least is not None) + [f"{value} > {r.most}::DOUBLE"] * (r.most is not None)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
i AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS k FROM i),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE k > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
  len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') IN ({stop})))::BIGINT AS n_stop_words,
  len(list_filter(w, lambda x: lower(x) != upper(x)))::BIGINT AS n_alpha_words,
  len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x != lower(x)))::BIGINT AS n_shouts,
  len(list_filter(l, lambda x: ltrim(x)[1] IN ('-', '*', chr(8226))))::BIGINT AS n_bullets,
  len(list_filter(l, lambda x: ends_with(rtrim(x), '...') OR ends_with(rtrim(x), chr(8230))))::BIGINT AS n_ellipses
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND NOT ({' OR '.join(bad)})) AS kept FROM f"""

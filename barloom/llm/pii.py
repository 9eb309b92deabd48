"""Personal data by weak supervision, in built-in functions only.

Patterns give candidate spans with code-point offsets. Labelers (strict shape, gazetteer, context,
surroundings) vote on each. The votes of the whole corpus are counted by kind and pattern of votes,
a table of 96 rows at most whatever the corpus; expectation-maximisation on it estimates each labeler's
reliability. Its posteriors are the labels of a logistic classifier that sees no votes, but the span and
what is beside it: shape, length, digits, variety, placeholders, neighbouring words and characters. So
what the votes agree on teaches what such spans look like, and spans that few labelers know are found by
their looks. It is fitted on at most EACH spans of each kind and pattern of votes, drawn by hash and
weighted to the counts of all. Spans of the base definition always stay; the classifier adds further
ones that overlap no base span. Added spans of different patterns may overlap each other.

Null and empty texts have no spans. Every row of `docs` gives one row, repeated ids included.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "secret")

# The base patterns, written so that Java's matcher neither recurses nor rescans a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?=(?:[\x20-]?[0-9]){13})[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Further candidates.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?|\.)[A-Za-z]{2,10}"
LOCAL_PHONE = r"(?<![0-9+().-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?i)(?<![A-Za-z])(?:token|api_?key|secret|password|passwd) {0,3}[=:] {0,3}[\"'][^\"'\s]{8,200}[\"']"

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
OPEN, CLOSE = "", ""
#: Code points before and after a span that the context labeler reads.
CONTEXT = 40

TOP_DOMAINS = "com|org|net|edu|gov|info|[a-z]{2}"
WORDS = {
    "email": "mail|contact|write|kontakt|courriel|correo",
    "ip": r"\bip\b|address|host|server|adresse|direcci",
    "card": r"card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|call|fax|mobile|telefon|llame",
    "id": r"ssn|social|passport|\bid\b|ausweis|dni",
    "secret": r"token|key|secret|password|passwd",
}
SPAN = "array<struct<kind:string,start:int,end:int,body:string,base:boolean,votes:int,marks:array<int>>>"

#: Weights of the span classifier, and spans of one kind and pattern of votes that it is fitted on at most.
MARKS = 1 << 11
EACH = 250


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find(text: Column, pattern: str) -> Column:
    """array<struct<start, end, body>> of a pattern's leftmost non-overlapping matches, in code points."""
    parts = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)

    def place(p: Column) -> Column:
        starts = F.aggregate(p, F.array().cast("array<int>"), lambda acc, x: F.array_append(acc, F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1) - 1, F.lit(0)) + F.length(x)))
        return _let(
            starts,
            lambda s: F.filter(
                F.transform(
                    p,
                    lambda x, i: F.when(
                        i > 0,
                        F.struct(
                            F.get(s, i - 1).alias("start"),
                            (F.get(s, i - 1) + F.length(F.substring_index(x, CLOSE, 1))).alias("end"),
                            F.substring_index(x, CLOSE, 1).alias("body"),
                        ),
                    ),
                ),
                lambda x: x.isNotNull(),
            ),
        )

    return _let(parts, place)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + F.coalesce(term(i), F.lit(0))) % 10 == 0


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def strict(kind: str, body: Column) -> Column:
    """The regex labeler: the strict shape of a kind."""
    n = F.length(_digits(body))
    return {
        "email": body.rlike(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$|[\[(] ?at ?[\])].*[\[(] ?dot ?[\])]"),
        "ip": body.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": n.between(16, 19) & luhn(_digits(body)),
        "phone": n.between(8, 15),
        "id": ~body.rlike("^(?:000|666|9)"),
        "secret": body.rlike("[0-9]") & body.rlike("[A-Za-z]"),
    }[kind]


def gazetteer(kind: str, body: Column) -> Column:
    """The gazetteer labeler: known domains, issuers and codes."""
    digits = _digits(body)
    return {
        "email": body.rlike(rf"(?i)[. )\]](?:{TOP_DOMAINS})$"),
        "ip": ~body.rlike(r"^0*(?:0|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."),
        "card": digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[4-8]|6011|62|64|65|9)"),
        "phone": body.rlike(r"^(?:\+(?:1|7|[2-9][0-9])|\(?[0-9]{3}\)?)"),
        "id": ~body.rlike(r"-00-|-0000$"),
        "secret": body.rlike(r"[0-9a-fA-F]{16}|[A-Za-z0-9_-]{20}"),
    }[kind]


def _level(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("string")


def marks(kind: str, body: Column, before: Column, after: Column) -> Column:
    """What the classifier sees of a span: one hashed place for each feature of the kind.

    `before` and `after` are the lower-cased code points around it.
    """
    # of a secret, what the quotes hold
    value = F.regexp_extract(body, "[\"']([^\"']*)[\"']$", 1) if kind == "secret" else body
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[A-Za-z]*[0-9]+[A-Za-z][A-Za-z0-9]*|[A-Za-z]+[0-9]+", "x"), "[A-Za-z]+", "a"), "[0-9]+", "9")
    digits = F.length(_digits(value))
    nearest = F.regexp_extract(before, r"([^\s\"'(<=:,;]+)[\s\"'(<=:,;]*$", 1)
    features = {
        "kind": F.lit(""),
        "shape": F.substring(shape, 1, 12),
        "length": _level(F.length(value)),
        "digits": F.floor(4 * digits / F.greatest(F.length(value), F.lit(1))).cast("string"),
        "variety": _level(F.size(F.array_distinct(F.split(value, "")))),
        "placeholder": value.rlike(r"(?i)(.)\1{3}|1234|abcd|example|change|dummy|sample|your|test|todo").cast("string"),
        # nothing but its check digit tells a card from other numbers
        "check": (digits.between(13, 19) & luhn(_digits(value)) if kind == "card" else F.lit(True)).cast("string"),
        "word before": nearest,
        "named": before.rlike(WORDS[kind]).cast("string"),
        "other thing": before.rlike(r"\b(?:version|isbn|order|invoice|part|item|model|figure|page|section|room|score|lot)\W+(?:\w+\W+){0,2}$").cast("string"),
        "sign before": F.regexp_replace(F.substring(before, -1, 1), r"\w", "w"),
        "sign after": F.regexp_replace(F.substring(after, 1, 1), r"\w", "w"),
    }
    return F.array(*[F.pmod(F.xxhash64(F.lit(f"{kind} {name}"), value), F.lit(MARKS)).cast("int") for name, value in features.items()])


def spans_of_kind(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Candidates of one pattern, with the labelers' votes as bits: shape 1, gazetteer 2, context 4, surroundings 8."""

    def one(s: Column) -> Column:
        body = s["body"]
        shape = strict(kind, body)
        start = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.lower(F.substring(text, start + 1, s["start"] - start))
        after = F.lower(F.substring(text, s["end"] + 1, F.lit(1)))
        beside = F.concat(F.substring(text, F.greatest(s["start"], F.lit(1)), F.when(s["start"] > 0, 1).otherwise(0)), F.substring(text, s["end"] + 1, F.lit(1)))
        bit = lambda c, k: F.when(c, k).otherwise(0)
        votes = bit(shape, 1) + bit(gazetteer(kind, body), 2) + bit(F.concat(before, F.lower(body) if kind == "secret" else F.lit("")).rlike(WORDS[kind]), 4) + bit(~beside.rlike(r"[A-Za-z0-9/\\_-]"), 8)
        # the base definition asks no shape of an email's domain
        is_base = F.lit(True) if kind == "email" and base else shape & F.lit(base)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), body.alias("body"), is_base.alias("base"), votes.cast("int").alias("votes"), marks(kind, body, before, after).alias("marks"))

    return F.transform(find(text, pattern), one)


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep` columns, and the candidate spans of each whole text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    own = own.withColumn("_t", F.when(F.col("_t").rlike(f"[{OPEN}{CLOSE}]"), F.translate("_t", OPEN + CLOSE, "��")).otherwise(F.col("_t")))
    own = own.withColumns({"_at": F.col("_t").contains("@"), "_dig": F.col("_t").rlike("[0-9]{3}|[0-9][ .-][0-9]")})
    t, none = F.col("_t"), F.array().cast(SPAN)
    guard = {"email": F.col("_at"), "ip": F.col("_dig") & t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), "card": F.col("_dig"), "phone": t.rlike(r"\+[0-9]")}
    found = [F.when(guard[k], spans_of_kind(t, k, p, True)).otherwise(none) for k, p in zip(BASE, (EMAIL, IP, CARD, PHONE))]
    found.append(F.when(t.rlike(r"[\[(] ?at ?[\])]"), spans_of_kind(t, "email", LOOSE_EMAIL, False)).otherwise(none))
    found.append(F.when(F.col("_dig"), spans_of_kind(t, "phone", LOCAL_PHONE, False)).otherwise(none))
    found.append(F.when(F.col("_dig"), spans_of_kind(t, "id", NATIONAL_ID, False)).otherwise(none))
    found.append(F.when(t.contains('"') | t.contains("'"), spans_of_kind(t, "secret", SECRET, False)).otherwise(none))
    return own.select("doc_id", *keep, F.concat(*found).alias("spans"))


def vote_counts(found: DataFrame) -> dict[tuple[str, int], int]:
    """How often each kind and pattern of votes occurs: len(KINDS) * 16 rows at most."""
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count().collect()
    return {(r["kind"], r["votes"]): r["count"] for r in rows}


def reliabilities(counts: dict[tuple[str, int], int], rounds: int = 50) -> dict[tuple[str, int], float]:
    """Posterior of each kind and pattern, by EM over independent labelers, each with a reliability of its own for every kind.

    Each labeler starts with ten imagined spans of each class of which it gets eight right, which tells
    the two classes apart.
    """
    post = {key: 0.02 + 0.96 * bin(key[1]).count("1") / 4 for key in counts}
    for kind in {k[0] for k in counts}:
        own = {k[1]: n for k, n in counts.items() if k[0] == kind}
        for _ in range(rounds):
            share = {v: post[kind, v] for v in own}
            yes = sum(n * share[v] for v, n in own.items())
            total = sum(own.values())
            prior = (yes + 1) / (total + 2)
            for v in own:
                odds = math.log(prior / (1 - prior))
                for j in range(4):
                    hit = (sum(n * share[u] for u, n in own.items() if u >> j & 1) + 8) / (yes + 10)
                    miss = (sum(n * (1 - share[u]) for u, n in own.items() if u >> j & 1) + 2) / (total - yes + 10)
                    p, q = (min(0.999, max(0.001, x)) for x in (hit, miss))
                    odds += math.log(p / q) if v >> j & 1 else math.log((1 - p) / (1 - q))
                post[kind, v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return post


def sample(found: DataFrame, each: int = EACH) -> DataFrame:
    """kind, votes and marks of at most `each` spans of each kind and pattern of votes, the first by hash."""
    spans = found.select("doc_id", F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.marks", F.xxhash64("doc_id", "s.start", "s.body").alias("_h"))
    rank = F.row_number().over(Window.partitionBy("kind", "votes").orderBy("_h"))
    return spans.withColumn("_rank", rank).where(F.col("_rank") <= each).select("kind", "votes", "marks")


def train(rows: list, counts: dict[tuple[str, int], int], post: dict[tuple[str, int], float], steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights by place of a logistic classifier of marks, by gradient steps on the posteriors.

    A sampled span stands for all of its kind and votes; kinds weigh alike, but for those of few spans.
    """
    w = np.zeros(MARKS)
    if not rows:
        return 0.0, w
    keys = [(r["kind"], r["votes"]) for r in rows]
    drawn = {k: keys.count(k) for k in set(keys)}
    of_kind = {kind: sum(n for k, n in counts.items() if k[0] == kind) for kind in KINDS}
    weight = np.array([counts[k] / drawn[k] / (of_kind[k[0]] + 10) for k in keys])
    weight /= weight.sum()
    want = np.array([post[k] for k in keys])
    at = np.array([r["marks"] for r in rows])
    bias, rate = 0.0, 4 / (at.shape[1] + 1)
    for _ in range(steps):
        error = weight * (want - 1 / (1 + np.exp(-np.clip(bias + w[at].sum(axis=1), -500, 500))))
        w += rate * (np.bincount(at.ravel(), np.repeat(error, at.shape[1]), MARKS) - 0.0005 * w)
        bias += rate * error.sum()
    return bias, w


def probability(span: Column, bias: float, w: np.ndarray) -> Column:
    weights = F.lit(w)
    return 1 / (1 + F.exp(-F.aggregate(span["marks"], F.lit(float(bias)), lambda z, i: z + F.get(weights, i))))


def detect(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), least: float = 0.8) -> DataFrame:
    """doc_id, `keep` columns and spans array<struct<kind, start, end, base>>, by kind as in KINDS, then start.

    A candidate outside the base is added if the classifier gives it a probability of `least` or more and
    no base span overlaps it. A null doc_id is kept like any other value.
    """
    found = written(candidates(docs, text, keep), "pii-candidates")
    counts = vote_counts(found)
    bias, w = train(sample(found).collect(), counts, reliabilities(counts))
    base = F.filter("spans", lambda s: s["base"])
    overlaps = lambda s: F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    found = found.withColumn("_base", base)
    added = F.filter("spans", lambda s: ~s["base"] & (probability(s, bias, w) >= least) & ~overlaps(s))
    order = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(
        F.array_sort(F.transform(F.concat("_base", added), lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")),
    )
    return found.select("doc_id", *keep, spans.alias("spans"))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the hash of the base spans and all spans as a string."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[F.size(F.filter(base, _is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )


def mask(found: DataFrame, text: str = "text") -> Column:
    """The text with each span replaced by its kind in angle brackets, overlapping spans joined; for a frame with `spans` and the text."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    t = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(t, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(ordered, start, step)
    return F.when(F.size("spans") == 0, t).otherwise(_let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(t, d["at"] + 1, F.length(t)))))

import random
import re

from barloom.llm import queries, templates


def tables(spark, docs, doc_texts, items):
    return docs(doc_texts, extra=True), spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")


ITEM = "A train leaves the old station at 9 am and goes 120 km to the town of Lyon where Anna waits for it since 9 o'clock."


def test_reparameterised(spark, docs):
    texts = [
        "Before it. " + ITEM + " After it.",
        "x " + ITEM.replace("9", "7").replace("120", "95").replace("Lyon", "Metz").replace("Anna", "Berta"),
        "x " + ITEM.replace("since 9", "since 8"),  # one number of the item became two
        ITEM.upper(),
        " ".join(reversed(ITEM.split())),
        None,
        "",
        "the town of " * 2000,
        ITEM[:60],
    ]
    df, bench = tables(spark, docs, texts, [ITEM, None, "", "too short"])
    got = {r.doc_id: r for r in templates.leaks(df, bench).collect()}
    assert {0, 1} <= set(got) and not {4, 5, 6, 7, 8} & set(got)
    assert got[0].coverage == 1 and got[0].first_at == 2 and got[0].item_id == 0
    assert 2 not in got or got[2].coverage < 1


def brute(texts, items, least=0.8):
    """For texts without slots: lower-cased words without marks."""
    cut = lambda t: [w for w in (re.sub(r"^[^\w]+|[^\w]+$", "", x) for x in t.lower().split()) if w]
    win = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    out = set()
    for i, item in enumerate(items):
        own = win(cut(item))
        for d, t in enumerate(texts):
            if own and len(own & win(cut(t))) >= least * len(own):
                out.add((d, i))
            if not own and any(cut(line) == cut(item) for line in t.split("\n") if cut(line)):
                out.add((d, i))
    return out


def test_plain_words_like_brute_force(spark, docs, save):
    random.seed(8)
    vocab = [f"{a}{b}" for a in "bcdfglmn" for b in ("ala", "obo", "uru", "ete", "ini")]
    line = lambda k: " ".join(random.choice(vocab) for _ in range(k))
    items = [line(random.randint(3, 40)) for _ in range(30)]
    texts = []
    for _ in range(150):
        t = line(random.randint(0, 60))
        if random.random() < 0.5:
            w = random.choice(items).split()
            for _ in range(random.choice([0, 0, 1, 2])):
                w[random.randrange(len(w))] = random.choice(vocab)
            t += ", " + " ".join(w) + "; " + line(5) if len(w) > 4 or random.random() < 0.5 else "\n" + " ".join(w) + "\n" + line(5)
        texts.append(t)
    df, bench = tables(spark, docs, texts, items)
    got = {(r.doc_id, r.item_id) for r in queries.op7_templates(spark, save(documents=df, benchmark=bench)).collect()}
    assert got == brute(texts, items)


NAMED = "The school has one garden with a long wall. Tom waters all of the green plants there on every warm day. Mary helps the others to pick ripe fruit. Dr. Stone then sells them in the market by the river for a fair price."


def test_names_at_sentence_starts(spark, docs):
    other = NAMED.replace("Tom", "Ben").replace("Mary", "Ruth").replace("Stone", "Wood")
    wrapped = re.sub(r" (Stone|of|helps|river)", r"\n\1", NAMED)
    texts = [NAMED, other, "x\n" + wrapped, wrapped.replace("Stone", "Wood"), "they say: " + NAMED[0].lower() + NAMED[1:], " ".join(NAMED.split()[::-1])]
    df, bench = tables(spark, docs, texts, [NAMED])
    got = {r.doc_id: r for r in templates.leaks(df, bench).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert {i for i, r in got.items() if r.coverage == 1} == {0, 1, 2, 3, 4} and len({r.n_windows for r in got.values()}) == 1


LONG = ITEM + " She reads the same book for 35 minutes while an old man next to her sleeps on a bench and a dog looks for 6 crumbs under it, then the two of them walk home through the rain."


def test_contradicting_slots_cost_their_windows_only(spark, docs):
    texts = [
        LONG.replace("since 9", "since 8"),  # one of two equal numbers altered
        LONG.replace("for 6", "for 35"),  # two numbers became equal
        LONG.replace("9", "7").replace("120", "95").replace("since 7", "since 4"),  # renumbered, but for one
        re.sub(r"\d+", lambda m: str(m.start() % 7), LONG.replace("o'clock", "oh").replace("same book", "old map").replace("the rain", "all snow")),
    ]
    df, bench = tables(spark, docs, texts, [LONG])
    got = {r.doc_id: r for r in templates.leaks(df, bench).collect()}
    assert set(got) == {0, 1, 2}
    assert all(r.n_found == r.n_windows - 5 for i, r in got.items() if i < 2)


def test_short_items(spark, docs):
    items = ["Capital of France?", "what is 7 + 5", "word", ".", "a b\nc d"]
    texts = ["x y\ncapital of france\nz", "The capital of France is large", "What is 7 + 5?", "What is 8 + 5?", "a word here", "so\nWord!\n", "a b c d", ".\n?"]
    df, bench = tables(spark, docs, texts, items)
    got = {(r.doc_id, r.item_id, r.n_windows, r.coverage) for r in templates.leaks(df, bench).collect()}
    assert got == {(0, 0, 1, 1.0), (2, 1, 1, 1.0), (5, 2, 1, 1.0), (6, 4, 1, 1.0)}


def test_a_stock_phrase_pairs_nothing(spark, docs):
    """Items that begin alike: the phrase pairs no document with an item; the items themselves are found."""
    random.seed(6)
    stock = "which of the following words is the best answer to this question here"
    own = lambda i: " ".join(f"{random.choice('bcdfg')}{random.choice('aeiou')}{random.choice('lmnrst')}{random.choice('aeiou')}" for _ in range(12))
    items = [f"{stock} {own(i)}" for i in range(40)]
    texts = [f"{own(0)} {stock} {own(0)}" for _ in range(40)] + [f"{own(0)} {items[3]} {own(0)}", items[7]]
    df, bench = tables(spark, docs, texts, items)
    got = templates.leaks(df, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(40, 3), (41, 7)}


def test_very_long_text(spark, docs):
    random.seed(2)
    filler = " ".join(random.choice(("stone", "river", "cloud", "Lyon", "12", "km.")) for _ in range(80_000))
    df, bench = tables(spark, docs, [f"{filler} {ITEM} {filler}", filler], [ITEM])
    assert [(r.doc_id, r.coverage, r.first_at) for r in templates.leaks(df, bench).collect()] == [(0, 1.0, 80_000)]


def test_empty(spark, docs):
    df, bench = tables(spark, docs, [ITEM], [ITEM])
    assert templates.leaks(df.limit(0), bench).count() == 0
    assert templates.leaks(df, bench.limit(0)).count() == 0


DENSE = [
    ("A train leaves Paris at 9 and travels 120 km at 60 km per hour. When does it arrive in Lyon?", "A train leaves Rouen at 7 and travels 95 km at 50 km per hour. When does it arrive in Metz?"),
    ("Solve 3 x + 5 = 20 for x.", "Solve 4 x + 7 = 31 for x."),
    ("What is 12 + 7 * 3 - 4?", "What is 15 + 8 * 2 - 6?"),
    ("Le matin, Élodie donne 12 pommes à Zoé, puis Élodie mange 3 poires avec son frère Éric au marché.", "Le matin, Ángela donne 15 pommes à Inès, puis Ángela mange 4 poires avec son frère Björn au marché."),
    ("Every day Tom buys 5 apples and gives 2 of them to Eve before the shop closes.", "Every day Mary Ann buys 8 apples and gives 3 of them to Dan Lee Cox before the shop closes."),
    ("The bridge near Lyon was built in 1883 by Anna and her brother from Ávila.", "THE BRIDGE NEAR LYON WAS BUILT IN 1883 BY ANNA AND HER BROTHER FROM ÁVILA."),
    ("THE CASTLE OF BASEL HAS 12 TOWERS AND ONE GATE OF IRON.", "The castle of Basel has 12 towers and one gate of iron."),
    ("There Ben Hill likes Eve Ray Poe and she likes 12 of 40 cats.", "there ben hill likes eve ray poe and she likes 12 of 40 cats."),
    ("1 2 3 4 5 6 7 8", "so 1 2 3 4 5 6 7 8 it is"),
    ("Bob Hill met Eve", "x\nBob Hill met Eve.\ny"),
]


def test_dense_slots(spark, docs):
    """Other values, names of other lengths and scripts, other case; values alone decide where there are no words."""
    texts = [d for _, d in DENSE] + [f"some words before 7 it and {d} Some words after it." for _, d in DENSE[:8]]
    swapped = ["1 2 3 4 5 6 7 9", "A train leaves Rouen at 7 and Metz is 95 km away", "What is 12 apples + 7 pears?", "Every day Tom buys bread."]
    df, bench = tables(spark, docs, texts + swapped, [i for i, _ in DENSE])
    got = {(r.doc_id, r.item_id) for r in templates.leaks(df, bench).collect()}
    assert got == {(i, i) for i in range(10)} | {(i + 10, i) for i in range(8)}


def test_recall_of_new_values(spark, docs):
    """Items of many shapes with all slots replaced, each in a text of its own among unrelated ones."""
    random.seed(12)
    names = ["Tom", "Ana", "Zoé", "Mary Ann", "Élodie", "Omar", "Dr. Wood", "Ivo", "Łucja", "Jean Paul Roy", "Ida", "Bo Li"]
    units = ["km", "kg", "miles", "hours", "dollars", "litres"]
    verbs, things = ["buys", "sells", "carries", "paints", "counts", "finds"], ["apples", "boxes", "chairs", "books", "stones", "lamps"]
    shape = [
        "On the way home {n} {v} %d {t} for %d {u} and then {n} {v} %d more, how many {t} are there",
        "{n} {v} %d {t}. {n} {v} %d {t}. After %d {u} they have lost %d of them. Who has most {t}",
        "If %d + %d * %d = %d for {t}, what is %d - %d",
        "the {t} of {n} weigh %d {u} while those of {n} weigh %d {u} in %d",
    ]

    def sample(s):
        out = s
        for key, some in (("{v}", verbs), ("{t}", things)):
            out = re.sub(re.escape(key), lambda _: random.choice(some), out)
        return out

    def values(s):
        own = random.sample(names, 2)
        s = re.sub(r"%d", lambda _: str(random.randrange(2, 9999)), s)
        return re.sub(r"\{u\}", lambda _: random.choice(units), re.sub(r"\{n\}", lambda _: own.pop(), s))

    frames = [f"{sample(random.choice(shape))} in the {chr(97 + i % 26)}{chr(97 + i // 26)}x case" for i in range(60)]
    items = [values(f) for f in frames]
    filler = lambda k: " ".join(random.choice(["river", "Lyon", "12", "km", "green", "walks", "Anna", "to", "the", "of"]) for _ in range(k))
    texts = [f"{filler(30)}. {values(f)}. {filler(30)}" for f in frames] + [filler(200) for _ in range(200)]
    df, bench = tables(spark, docs, texts, items)
    got = {(r.doc_id, r.item_id) for r in templates.leaks(df, bench).collect()}
    found = sum((i, i) in got for i in range(60))
    assert found >= 54 and not [x for x in got if x[0] >= 60]

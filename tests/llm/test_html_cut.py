import itertools
import random

from barloom.llm import html_cut, queries

ARTICLE = "<h1>A title of the page</h1><p>First &amp; second words, all in a <b>bold</b> paragraph of the page.<p>It goes on\n  with more and more words until it ends.</p>"
WANT = "A title of the page First & second words, all in a bold paragraph of the page. It goes on with more and more words until it ends."


def test_minimum_cut_is_minimal():
    random.seed(1)
    for _ in range(300):
        n = random.randint(1, 8)
        scores = [random.choice([-2, -1, -0.5, 0.25, 1, 3]) + random.random() / 8 for _ in range(n)]
        edges = [(a, b, random.random() * 2) for a in range(n) for b in range(a + 1, n) if random.random() < 0.5]
        cost = lambda side: sum(-s if not x and s > 0 else 0 for x, s in zip(side, scores)) * -1 + sum(-s for x, s in zip(side, scores) if x and s < 0) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: B023, E731
        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(html_cut.min_cut(scores, edges)) - best) < 1e-6


def test_templates():
    outside = "<div id='comments'><h3>Comments</h3><div class='comment'><p>I liked this very much, thank you for it all.</p></div></div>"
    for page in (
        f"<html><head><title>x</title></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article>{ARTICLE}</article><footer>&copy; me</footer>",
        f"<body><div class='menu'><a>One</a> <a>Two</a></div><div id=content>{ARTICLE}{outside}</div><div class=footer>All rights reserved by us.</div>",
        f"<div class='cookie-notice'>We use cookies on this site to make it better for you.</div><main>{ARTICLE}</main><aside><p>Read also this long piece of text, it is very good.</p></aside>",
        f"<header><h2>The site</h2></header><section>{ARTICLE}</section><form><label>Mail</label><p>Please sign up here for it.</p></form><script>var a='<p>no</p>'</script><!-- <p>no</p> -->",
    ):
        assert html_cut.main_text(page) == WANT, page


def test_a_name_or_form_does_not_take_the_page():
    """Classes that tell a state, a form around the page, a wrapper of an unlucky name."""
    side = "<div class='sidebar'><p>Read this other thing, it is good for you.</p></div>"
    for page in (
        f"<body><nav><a>Home</a></nav><div class='content with-sidebar'>{ARTICLE}</div>{side}",
        f"<div id='page' class='no-sidebar'>{ARTICLE}</div>",
        f"<article><div class='post-body share-enabled'>{ARTICLE}</div></article>",
        f"<form id='aspnetForm'><div class='menu'><a>Home</a></div><div>{ARTICLE}</div>{side}<div class='footer'>All rights reserved by us.</div></form>",
        f"<div class='wrapper share'><div class='menu'><a>x</a></div>{ARTICLE}</div>",
    ):
        assert html_cut.main_text(page) == WANT, page


def test_a_short_article_stays_beside_much_else():
    short = "<article><h1>Short one</h1><p>It is only this long.</p></article>"
    for other in ("<div class='sidebar'>", "<form>", "<div class='related'>", "<div class='comments'>"):
        much = "".join(f"<p>Paragraph {i} of something else, which goes on for long.</p>" for i in range(5))
        assert html_cut.main_text(f"{short}{other}{much}</{other[1:5].split(' ')[0].strip('>')}>") == "Short one It is only this long.", other


def test_comments_without_a_name_go_from_their_heading_on():
    said = "<div><p>I liked this very much, thank you for it all, it was great fun.</p></div>"
    for head in ("3 responses", "Comments", "Reader comments (12)", "Leave a reply"):
        assert html_cut.main_text(f"<main>{ARTICLE}<h3>{head}</h3>{said}</main>") == WANT, head
    about = f"<main>{ARTICLE}<h3>Comments on the bill</h3><p>They said that it was good, and it was.</p></main>"
    assert html_cut.main_text(about).endswith("Comments on the bill They said that it was good, and it was.")


def test_dropped_elements_end_where_they_end():
    for page in (
        f"<header><svg class='i'/></header><article>{ARTICLE}</article>",
        f"<header><svg><path d='M0'/><title>no</title><text>no</text></header><article>{ARTICLE}</article>",
        f"<header><button>Menu</header><article>{ARTICLE}</article>",
        f"<button>Menu<article>{ARTICLE}</article>",
        f"<select><option>One<option>Two<article>{ARTICLE}</article>",
        f"<div><template><p>no</p></div><article>{ARTICLE}</article>",
        f"<article>{ARTICLE.replace('words,', 'words,<svg><foreignObject><p>no</p></foreignObject></svg><button><div>no</div></button><select><option>no</select><template><p>no</p></template>')}</article>",
    ):
        assert html_cut.main_text(page) == WANT, page
    math = "<math/><math><mi>x</mi><mo>+</mo><mn>1</mn></math>"
    assert html_cut.main_text(f"<article>{ARTICLE.replace('words,', f'words {math},')}</article>") == WANT.replace("words,", "words x+1,")


def test_the_cut_decides_where_the_classifier_is_unsure():
    """Short blocks that the classifier gives to the boilerplate: kept among content, left out among boilerplate."""
    long = "<div>Here is a sentence of the story, with enough words to be sure of it.</div>"
    among = f"<div>{long}<div>Go on</div>{long}</div>"
    alone = "<div><div>Go on</div><div>Go off</div></div>"
    for page, want in ((among, 3), (alone, 0)):
        texts, scores, _, _ = html_cut.blocks_of(page, html_cut.Weights())
        assert scores[texts.index("Go on")] < 0
        got = html_cut.main_text(page)
        assert ("Go on" in got) == bool(want)
    plain = html_cut.Weights(adjacent=0.0, container=0.0)
    assert "Go on" not in html_cut.main_text(among, plain)


def test_odd_pages():
    for page in ("", " ", "<", "<p", "<!-- never closed", "<script>never closed", "</div></div>", "&#x0;&nosuch;", "<div>" * 3000, "<a href='>"):
        assert isinstance(html_cut.main_text(page), str)
    many = "<article>" + "".join(f"<p>Paragraph {i} has a few words in it.</p>" for i in range(20_000)) + "</article>"
    assert html_cut.main_text(many).count("Paragraph") == 20_000


def test_query(spark, save):
    page = f"<article>{ARTICLE}</article>"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", page, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(tuple(r) for r in queries.op10_html_cut(spark, save(pages=df)).collect() if r.url)
    assert got == [(1, "u", WANT, len(WANT)), (1, "u", WANT, len(WANT)), (3, "u", "", 0)]
    assert queries.op10_html_cut(spark, save(pages=df.limit(0))).count() == 0

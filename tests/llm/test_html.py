import math

from tekstara.llm.html_extract import extract, extract_text, mark_of, measure, parse

BODY = "".join(f"<p>Paragraph number {i} has enough words to be read as text, with one <a href='#'>link</a> inside.</p>" for i in range(6))
WANT = [f"Paragraph number {i} has enough words to be read as text, with one link inside." for i in range(6)]


def page(inner, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var x = '</p>';</script></head><body>{inner}</body></html>"


def test_article_without_boilerplate():
    links = "<ul>" + "".join(f"<li><a href='/{i}'>menu entry {i}</a></li>" for i in range(30)) + "</ul>"
    inner = f"<header>Site</header><nav>{links}</nav><div class='ad'>Buy it now, it is cheap and good.</div><div class='cookie-notice'>We use cookies a lot.</div><article><h1>A title</h1>{BODY}<form>Your mail <input></form><section class='comments'><p>Reader says first, and more.</p></section></article><aside>side</aside><footer>&copy; all</footer>"
    assert extract(page(inner)).split("\n") == ["A title", *WANT]


def test_no_article_element():
    links = "<ul>" + "".join(f"<li><a href='/{i}'>entry {i}</a></li>" for i in range(40)) + "</ul>"
    assert extract(page(f"<div id='wrap'><div class='x1'>{links}</div><div class='x2'><h1>Head</h1><div>{BODY}</div></div></div>")).split("\n") == ["Head", *WANT]


def test_soup_and_references():
    t = extract("<html><body><article><h1>One &amp; two&#33;</h1><p><b>First  \n line.<br>more<p>Second &lt;b&gt; <!-- no <p> --> end<script>if (a < b) '</p>'</script></article><footer>x</foo")
    assert t.split("\n") == ["One & two!", "First line. more", "Second <b> end"]


def test_lists_tables_and_case():
    t = extract(page("<ARTICLE><H1>T</H1><P>Some opening words stand here for length.</P><UL><LI>one<LI>two</UL><table><tr><td>a<td>b</table></ARTICLE>"))
    assert t.split("\n") == ["T", "Some opening words stand here for length.", "one", "two", "a", "b"]


def sections(*counts):
    texts = [[f"Section {s} paragraph {i} " + "goes on with plain words " * 15 + "and ends." for i in range(n)] for s, n in enumerate(counts)]
    return ["".join(f"<p>{t}</p>" for t in x) for x in texts], [t for x in texts for t in x]


def test_sibling_sections_in_body():
    (a, b), want = sections(5, 3)
    for tag in ("section", "div"):
        assert extract(page(f"<h1>A title</h1><{tag}>{a}</{tag}><{tag}>{b}</{tag}>")).split("\n") == ["A title", *want]


def test_sibling_sections_beside_links():
    (a, b, c), want = sections(5, 3, 1)
    links = "<div class='x1'><ul>" + "".join(f"<li><a href='/{i}'>menu entry {i}</a></li>" for i in range(60)) + "</ul></div>"
    inner = f"{links}<h1>A title</h1><section>{a}</section><h2>More</h2><section>{b}</section>{links}<div>{c}</div>{links}"
    for x in (inner, f"<div>{inner}</div>"):
        assert extract(page(x)).split("\n") == ["A title", *want[:5], "More", *want[5:]]
        assert extract(f"<html>{x}</html>").split("\n") == extract(x).split("\n") == ["A title", *want[:5], "More", *want[5:]]


def test_wrapper_of_content_and_sidebar():
    for name in ("content-sidebar-wrap", "layout-with-sidebar"):
        assert extract(page(f"<div class='{name}'><article><h1>Head</h1>{BODY}</article><div class='sidebar'><p>Not this text.</p></div></div>")).split("\n") == ["Head", *WANT]
    assert extract(page(f"<div class='sidebar-wrap'><p>Not this.</p></div><article>{BODY}</article>")).split("\n") == WANT


def test_rows(spark):
    rows = [(1, "u", page(f"<article>{BODY}</article>")), (2, None, None), (3, "u", ""), (4, "u", "no markup at all"), (4, "u", "no markup at all"), (None, "u", "<"), (6, "u", page("<article><p>" + "word " * 60_000 + "</article>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = extract_text(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "\n".join(WANT) and by[2] == by[3] == "" and by[4] == "no markup at all" and len(by[6]) == 60_000 * 5 - 1
    assert extract_text(df.limit(0)).count() == 0


SIX = "".join(f"<p>Paragraph number {i} has enough words to be read as text, and then some more of them.</p>" for i in range(6))
PLAIN = [f"Paragraph number {i} has enough words to be read as text, and then some more of them." for i in range(6)]


def test_quotes_that_open_or_close_nothing():
    assert extract(page(f"<article><p data-x=it's>First.</p>{SIX}<p>don't</p></article>")).split("\n") == ["First.", *PLAIN, "don't"]
    assert extract(page(f'<article><p class="x>Hello you</p>{SIX}</article>')).split("\n") == ["Hello you", *PLAIN]
    assert extract(page(f'<article><p class="x>Hello you</p><p class="y">Next one</p>{SIX}</article>')).split("\n") == ["Hello you", "Next one", *PLAIN]
    assert extract(page(f'<article><p title="a > b" data-html="<b>x</b>">Hello</p>{SIX}</article>')).split("\n") == ["Hello", *PLAIN]


def test_names_of_layout_and_state():
    for attrs in ("class='page header-fixed'", "class='comments-open post'", "id='social-history'", "class='side-effects'", "class='sidebar'", "class='ad'"):
        assert extract(page(f"<div {attrs}><article><h1>T</h1>{SIX}</article></div>")).split("\n") == ["T", *PLAIN], attrs
    assert extract(page(f"<article><h1>T</h1>{SIX}<section class='side-effects'><p>Some may feel sick after it, others may not.</p></section></article>")).split("\n")[-1].startswith("Some may feel")
    assert [bool(mark_of(x)) for x in ("site-footer", "comment-list", "commentList", "ad-3", "adslot", "has-sidebar", "header-fixed", "address", "lead")] == [True] * 4 + [False] * 5


def test_hidden_elements_and_forms():
    t = extract(page(f"<form id='all'><article>{SIX}<div style='color:red; DISPLAY : none'>not seen</div><p hidden>nor this</p><form>Your mail <input></form></article></form>"))
    assert t.split("\n") == PLAIN


def test_comments_longer_than_the_article():
    talk = "".join(f"<article class='comment'><p>Reader {i} says a lot about this, and more and more of it goes on.</p></article>" for i in range(18))
    for block in (f"<div id='comments'>{talk}</div>", f"<section class='comment-list'>{talk}</section>", talk.replace(" class='comment'", "")):
        assert extract(page(f"<article><h1>T</h1>{SIX}{block}</article>")).split("\n") == ["T", *PLAIN]


def test_header_of_an_article():
    assert extract(page(f"<header><h1>Site</h1></header><article><header><h1>The title</h1><span>by someone</span></header>{SIX}</article>")).split("\n") == ["The title", *PLAIN]


def test_references_end_at_tags():
    assert extract(page("<article><p>a &am<b>p;</b> b &lt;i&gt; c</p></article>")) == "a &amp; b <i> c"


def test_time_grows_with_the_page():
    import time

    for piece in ("<a href=\"x ", "<div></p>", "<li><b>", "<!-- ", "<p class='", "</", "<script>", "<td><i></table>", "a=\"<"):
        began = time.time()
        extract(piece * 20_000)
        assert time.time() - began < 5, piece


def test_densities_against_brute_force():
    import random

    rng = random.Random(3)

    def tree(depth):
        kids = []
        for _ in range(rng.randint(1, 3)):
            kids.append("w" * rng.randint(1, 30) if depth == 0 or rng.random() < 0.4 else (rng.choice(["div", "a", "b", "section"]) if depth > 1 else "a", tree(depth - 1)))
        return kids

    def markup(kids):
        return "".join(k if isinstance(k, str) else f"<{k[0]}>{markup(k[1])}</{k[0]}>" for k in kids)

    def sizes(kids, link=False):
        """characters, link characters, tags, link tags"""
        c = l = t = lt = 0
        for k in kids:
            if isinstance(k, str):
                c, l = c + len(k), l + len(k) * link
            else:
                inner = sizes(k[1], link or k[0] == "a")
                c, l, t, lt = c + inner[0], l + inner[1], t + inner[2] + (k[0] != "b"), lt + inner[3] + (k[0] == "a")
        return c, l, t, lt

    for _ in range(60):
        kids = [("div", tree(3)), ("div", tree(2))]
        root = parse(f"<html><body>{markup(kids)}</body></html>")
        nodes = measure(root)
        body = next(x for x in nodes if x.tag == "body")
        c, l, t, lt = sizes(kids)
        assert (body.chars, body.links, body.tags, body.link_tags) == (c, l, t, lt)
        for x, k in zip(body.kids, kids, strict=True):
            cx, lx, tx, ltx = sizes(k[1])
            want = 0.0
            if cx > lx:
                base = math.log(cx / (cx - lx) * lx + l / c * cx + math.e)
                want = cx / max(tx, 1) * max(math.log(cx / max(lx, 1) * max(tx, 1) / max(ltx, 1)), 0) / base
            assert abs(x.density - want) < 1e-9
        assert abs(body.total - sum(x.density for x in body.kids)) < 1e-9

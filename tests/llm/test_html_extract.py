import html
import random
import re

import numpy as np
import pytest

from lodestone.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def _errors(pages):
    """Blocks classified wrongly, and all blocks."""
    wrong = total = 0
    for page, marks in pages:
        got = H.classify(H.tree(), H.features(H.blocks(page)))
        assert len(got) == len(marks)
        wrong += sum(k != (m == "1") for k, m in zip(got, marks, strict=True))
        total += len(marks)
    return wrong, total


def test_tree_fits_its_table():
    wrong, total = _errors(H.LABELLED)
    assert wrong <= 0.05 * total


def test_tree_asks_for_words_and_links_of_neighbours():
    asked = H.used(H.tree())
    assert {"words", "words_before", "density_before", "words_after", "density_after"} <= asked, H.shown(H.tree())
    # `unmarked` is the words outside links, so it holds the block's own link density
    assert asked & {"link_density", "unmarked"}
    x = H.features(H.blocks(f"<div><p>{W40} <a href=x>{W40}</a></p></div>"))
    assert x[0, H.FEATURES.index("unmarked")] == len(W40.split())


@pytest.mark.parametrize(("style", "share"), [("tags", 0.01), ("wrapped", 0.01), ("names", 0.04), ("bare", 0.07), ("linked", 0.07), ("mislead", 0.07), ("plain", 0.03), ("story", 0.03)])
def test_held_out_pages(style, share):
    """Blocks of pages that the table does not hold; without or with misleading marks only words and links are left."""
    wrong, total = _errors([H.labelled(H.layout(random.Random(10_000 + k)), style) for k in range(150)])
    assert wrong <= share * total


def test_names_do_not_decide():
    words = " ".join(["word"] * 30)
    assert H.extract(f'<div class="share-prices"><article><p>{words}</p></article></div>') == words
    assert H.extract(f'<div class="social-history"><main><h1>a b c</h1><p>{words}</p></main></div>') == f"a b c {words}"
    page = f'<div><ul><li><a href=a>x</a></li><li><a href=b>y</a></li></ul></div><div class="search-party"><h1>one two</h1><p>{words * 2}</p><p>{words * 3}</p></div>'
    assert words * 2 in H.extract(page) and " ".join((words * 3).split()) in H.extract(page)


def test_menus_of_any_depth_stay_out():
    for n in (10, 450, 5000):
        assert H.extract("<nav>" + "<div>" * n + "menu words here") == ""


def _page(rng, words):
    """A page that is not in the table, and its main text."""
    raw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    say = lambda n: html.escape(raw(n))
    body = [raw(rng.randint(1, 90)) for _ in range(rng.randint(1, 6))]
    title = raw(rng.randint(1, 8))
    text = " ".join([title, *body])
    inner = f"<h1>{html.escape(title)}</h1>" + "".join(f"<p>{html.escape(b)}</p>" if rng.random() < 0.7 else f"<p><b>{html.escape(b)}<br>" for b in body)
    extra = rng.choice(["", f'<aside class="sidebar">{say(30)}</aside>', f'<form action="/s"><p>{say(5)}</p></form>', f'<div id="comments"><p>{say(60)}</p></div>'])
    return (
        f'<!DOCTYPE html><html><head><title>{say(4)}</title><script>if (a < b) "</p>";</script><style>p {{}}</style></head><body><nav><ul>'
        + "".join(f'<li><a href="/{i}">{say(1)}</a></li>' for i in range(5))
        + f'</ul></nav><!-- <p>{say(9)}</p> --><div class="ad">{say(rng.randint(3, 40))}</div><article>{inner}</article>{extra}<footer>&copy; {say(rng.randint(2, 30))}</footer></body></html>',
        text,
    )


def test_unseen_pages():
    rng = random.Random(6)
    words = ["alpha", "été", "x&y", "a<b", "naïve.", "42", "gross"]
    for _ in range(300):
        page, text = _page(rng, words)
        assert H.extract(page) == text


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("<nav><a href=x>home</a></nav>", ""),
        ("<article><p>a\n\t b<b>c</b> &amp;amp; &eacute;&#233;&nbsp;d</article>", "a bc &amp; éé d"),
        ("<article><p>one<p>two<div class='ad'>buy</div><p>three</article>", "one two three"),
        ("<article><p title='a > b'>x</p><p>1 < 2</p></article>", "x 1 < 2"),
        ("<article><p>open", "open"),
        ("<article><p>x</p><script>never closed <p>y</p>", "x"),
        ("<article><p>x</p><!-- never closed <p>y</p>", "x"),
        ("<article><p>x <a", "x"),
    ],
)
def test_small(page, want):
    assert H.extract(page) == want


W40 = " ".join(["The quick story goes on and on"] * 6)
#: Pages written by hand, none made by the table's rule: page and main text.
BY_HAND = [
    ("<article><p title=Bob's>First paragraph of it.</p><p>they don't go</p></article>", "First paragraph of it. they don't go"),
    ("<article><p title=Bob's data-x=a\"b>One.</p><a href='x>y'>two</a></article>", "One. two"),
    (f"<p>{W40}</p>", W40),
    (f"<html><body><p>{W40}</p></body></html>", W40),
    (f"<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul><p>{W40}</p><p>{W40}</p>", f"{W40} {W40}"),
    (f"<a href=/>Home</a><p>{W40}</p><p>{W40}</p><p>{W40}</p>", f"{W40} {W40} {W40}"),
    (f"<h1>A title of four</h1><p>{W40}</p>", f"A title of four {W40}"),
    (f"<div class='social-share-story'><p>{W40}</p><p>{W40}</p></div>", f"{W40} {W40}"),
    (f"<ul><li>Home</li><li>About us</li><li>Contact</li></ul><p>{W40}</p><p>{W40}</p>", f"{W40} {W40}"),
    (f"<ul><li>Home</li><li>About us</li><li>Contact</li></ul><h1>What happened</h1><p>{W40}</p>", f"What happened {W40}"),
    (f"<nav>Home</nav><p>{W40}</p><footer>All rights reserved by someone or other</footer>", W40),
    (f"<div id=top><a href=/>Site</a> <a href=/x>More</a></div><div id=c><h2>Title here</h2>{W40}<br>{W40}</div>", f"Title here {W40} {W40}"),
    (f"<div class=cookie-notice>We use cookies to make this site work as you expect it to, read more</div><div><p>{W40}</p></div>", W40),
    (f"<main><p>Short.</p><p>{W40}</p></main><div class=comments><p>{W40}</p></div>", f"Short. {W40}"),
    (f"<table><tr><td><a href=/1>One</a></td><td><p>{W40}</p><p>{W40}</p></td></tr></table>", f"{W40} {W40}"),
]


@pytest.mark.parametrize(("page", "want"), BY_HAND)
def test_pages_written_by_hand(page, want):
    assert H.extract(page) == want


def test_unmarked_pages():
    """Pages of one to four paragraphs by another rule than the table's: nearly all words of the text, and no menus."""
    rng = random.Random(77)
    say = lambda n: " ".join(f"word{rng.randint(0, 999)}" for _ in range(n))
    same = 0
    for _ in range(300):
        body = [say(rng.randint(12, 130)) for _ in range(rng.randint(1, 4))]
        items = [say(rng.randint(1, 2)) for _ in range(rng.randint(2, 6))]
        menu = rng.choice(["", "<ul>" + "".join(f"<li><a href=/x>{i}</a></li>" for i in items) + "</ul>", "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", f"<nav>{say(4)}</nav>"])
        title = [say(rng.randint(2, 9))] if rng.random() < 0.5 else []
        inner = "".join(f"<h1>{t}</h1>" for t in title) + "".join(f"<p>{b}</p>" for b in body)
        page = menu + rng.choice(["%s", "<div>%s</div>", "<div class=share-story>%s</div>", "<section>%s</section>"]) % inner
        same += H.extract(page) == " ".join(title + body)
    assert same >= 285, same


def test_linear_on_hostile_pages():
    for page in ["<a " * 60_000, "<" * 200_000, '<p "' * 50_000, "<div>" * 60_000 + "x", "<p>x" * 60_000, "<!-- " * 60_000, "&" * 200_000, "<a 'x\">" * 40_000, "<a b='" * 60_000, "<a b=" * 60_000, '<a b="c>' * 60_000]:
        H.extract(page)


def test_training():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(400, 4))
    y = (x[:, 1] > 0.4) & (x[:, 3] < 0.7)
    tree = H.train(x[:300], y[:300])
    assert (H.classify(tree, x[300:]) == y[300:]).mean() > 0.95


def test_query(spark):
    rng = random.Random(7)
    made = [_page(rng, ["w1", "w2", "ß"]) for _ in range(40)]
    rows = [(i, f"u{i}", p, "x", 1) for i, (p, _) in enumerate(made)] + [(None, None, None, None, None), (1, "u1", made[1][0], "x", 1)]
    got = H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got if r.page_id is not None) == sorted([(i, t, len(t)) for i, (_, t) in enumerate(made)] + [(1, made[1][1], len(made[1][1]))])
    assert [(r.text, r.n_chars) for r in got if r.page_id is None] == [("", 0)]
    assert len([r for r in got if re.match("u1$", r.url or "")]) == 2
    assert H.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


ARTICLE = "<article><p>one two three</p></article>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<aside><table>" + "<tr><td>x" * 500 + "</table></aside>" + ARTICLE, "one two three"),
        ("<form><table>" + "<tr><th>x<td>y" * 500 + "</form>" + ARTICLE, "one two three"),
        ("<nav><dl>" + "<dt>x<dd>y" * 500 + "</dl></nav>" + ARTICLE, "one two three"),
        ("<aside>" + "<tr><td>x" * 500 + "</aside>" + ARTICLE, "one two three"),
        ("<aside>" + "<div>x" * 500 + "</aside>" + ARTICLE, "one two three"),
        (ARTICLE + '<div class="comments">' + "<div>" * 600 + "<p>" + "word " * 60, "one two three"),
        ("<article>" + "<div>" * 600 + "<p>one two three", "one two three"),
    ],
)
def test_deep_and_unclosed(page, want):
    assert H.extract(page) == want


def test_implied_ends_keep_to_their_table_and_list():
    def tags(page):
        opened = H.Open()
        for m in re.finditer(r"<(/?)([a-z0-9]+)>", page):
            if m.group(1):
                opened.close(m.group(2))
            else:
                opened.imply_ends(m.group(2))
                opened.push(m.group(2))
        assert opened.firm == [i for i, (t, *_) in enumerate(opened.stack) if t not in H._LOOSE]
        return " ".join(t for t, *_ in opened.stack)

    assert tags("<table><tr><td><div><tr><th>") == "table tr th"
    assert tags("<table><tbody><tr><td><tbody><tr>") == "table tbody tr"
    assert tags("<table><tr><td><table><tr><td><td>") == "table tr td table tr td"
    assert tags("<table><tr><td><table><tr></table><td>") == "table tr td"
    assert tags("<dl><dt><div><dd><p><dt>") == "dl dt"
    assert tags("<dl><dd><dl><dt>") == "dl dd dl dt"
    assert tags("<ul><li><div><li><ul><li>") == "ul li ul li"


def test_open_elements_like_brute_force():
    rng = random.Random(9)
    names = ["div", "aside", "article", "section", "nav", "form", "ul", "table"]
    for _ in range(30):
        page, stack, want = [], [], []
        for i in range(1500):
            tag = rng.choice(names)
            if rng.random() < 0.4:
                page.append(f"</{tag}>w{i}")
                if tag in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(tag) :]
            else:
                page.append(f"<{tag}>w{i}")
                stack.append(tag)
            inner = len(stack) - stack[::-1].index("article") if "article" in stack else 0
            inside, above = sum(t in H._OTHER_TAGS for t in stack[inner:]), sum(t in H._OTHER_TAGS for t in stack[:inner])
            want.append((f"w{i}", int("article" in stack), int(inside > 0), int(above > 0)))
        assert [(b.text, b.in_article, b.in_other, b.above) for b in H.blocks("".join(page))] == want


def test_deep_pages_take_linear_time():
    import time

    began = time.process_time()
    H.blocks("<dl><dd>" * 50_000 + "<div><dt>" * 50_000 + "x</p>" * 50_000)
    H.blocks("<table><tr><td>" * 50_000 + "<div>x" * 50_000 + "</nav>" * 50_000)
    assert time.process_time() - began < 20

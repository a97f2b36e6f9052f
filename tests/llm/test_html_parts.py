"""Parts of pages by their share of the text, readers' comments, and the scores against a plain reckoning over the same tree."""

import random

import pytest

from scrivel.llm import html_text as H

LONG = "A sentence of the article, which has commas, and goes on for long enough to count as a paragraph. "
GOOD = "".join(f"<p>{LONG}{k}</p>" for k in range(8))
TEXT = "\n\n".join(f"{LONG}{k}" for k in range(8))


@pytest.mark.parametrize("page", [f"<body><form id=aspnetForm><input name=v>{GOOD}</form></body>", f"<body><nav>Menu</nav><div class='widget'>{GOOD}</div></body>", f"<div class='social'>{GOOD}</div><footer>F</footer>", f"<form><fieldset><div class=post>{GOOD}</div></fieldset></form>", f"<div class='widget'>{GOOD}</div><div class=comments><p>{LONG * 30}</p></div>"])
def test_a_part_with_most_of_the_text_is_the_article(page):
    assert H.main_text(page) == TEXT


@pytest.mark.parametrize("part", [f"<form><p>{LONG}</p></form>", f"<div class=widget><p>{LONG}</p></div>", f"<div class=sidebar><p>{LONG}</p></div>", f"<section id=discussion><h2>Talk</h2><div class=author>Ann</div><p>{LONG * 3}</p></section>", f"<div class=responses><p>{LONG * 20}</p><textarea>x</textarea></div>", f"<div class='user-responses'><form><input></form><p>{LONG * 20}</p></div>"])
def test_others_are_not(part):
    assert H.main_text(f"<body><div class=post>{GOOD}</div>{part}</body>") == TEXT


def test_a_discussion_within_the_article_is_text():
    assert H.main_text(f"<article>{GOOD}<section id=discussion><h2>Discussion</h2><p>{LONG}9</p></section></article>") == f"{TEXT}\n\nDiscussion\n\n{LONG}9"


def plain_best(root):
    """Points of each element, reckoned from its own subtree each time."""
    every = []

    def walk(e):
        every.append(e)
        for c in e.children:
            if not isinstance(c, str):
                walk(c)

    def chars(e, inside=False):
        n = sum(len(c.strip()) for c in e.children if isinstance(c, str))
        return n + sum(chars(c) for c in e.children if not isinstance(c, str))

    def links(e):
        return chars(e) if e.tag == "a" else sum(links(c) for c in e.children if not isinstance(c, str))

    walk(root)
    points = {}
    for e in every:
        if e.tag not in H.BLOCK and e.parent is not None or e.tag == "html":
            continue
        own = H._own_text(e)
        if len(own) < H.LEAST_PARAGRAPH:
            continue
        gained = 1 + sum(own.count(x) for x in ",、，") + min(len(own) / 100, 3)
        up = e.parent if e.tag in ("p", "pre", "li", "td", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote") else e
        for share in (1, 2, 6, 9, 12):
            if up is None or up.tag == "#root" and share > 1:
                break
            points.setdefault(id(up), [up, H.PRIOR.get(up.tag, 0.0) + (5 if H._words(up) & H.GOOD else 0)])[1] += gained / share
            up = up.parent
    marks = {k: p * (1 - links(e) / max(chars(e), 1)) for k, (e, p) in points.items()}
    order = [id(e) for e in every if id(e) in marks]
    return max(order, key=marks.__getitem__) if order else None, marks


@pytest.mark.parametrize("seed", range(40))
def test_scores_against_a_plain_reckoning(seed):
    rng = random.Random(seed)

    def piece(depth):
        kind = rng.choice(["p", "p", "div", "section", "ul", "table", "a", "text", "article"]) if depth < 5 else rng.choice(["p", "text", "a"])
        if kind == "text":
            return LONG[: rng.randrange(90)]
        if kind in ("p", "a"):
            return f"<{kind} href=x>{LONG[: rng.randrange(5, 98)] * rng.randrange(1, 3)}</{kind}>"
        inner = "".join(piece(depth + 1) for _ in range(rng.randrange(1, 5)))
        return f"<{kind} class='{rng.choice(['post', 'x', 'y story', ''])}'>{'<li>' if kind == 'ul' else '<tr><td>' if kind == 'table' else ''}{inner}</{kind}>"

    elements = H.prune(H.parse("<body>" + "".join(piece(0) for _ in range(5))))
    best, marks = plain_best(elements[0])
    got = H.score(elements, H.LEAST_PARAGRAPH)
    assert (id(got) if got is not None else None) == best
    assert all(e.points is None or abs(e.points - marks[id(e)]) < 1e-9 for e in elements)

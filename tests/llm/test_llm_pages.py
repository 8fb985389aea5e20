"""Main text of pages without one wrapper around the article, and of pages with layout classes."""

import pytest

from tamis.llm.html_text import main_text

TEXT = [f"Paragraph {i} " + "has a good number of plain words in it, " * 8 + "and an end." for i in range(6)]
P = [f"<p>{t}</p>" for t in TEXT]
MENU = '<div><a href="/a">Home page</a> <a href="/b">Other pages</a></div>'


@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>"])
def test_sections_side_by_side(wrap):
    page = "<body>" + wrap.format(f"<div>{''.join(P[:3])}</div><div>{''.join(P[3:])}</div>") + "</body>"
    assert main_text(page).split("\n") == TEXT


def test_heading_beside_the_text():
    page = f"<body>{MENU}<h1>Title</h1><div>{''.join(P)}</div><footer>foot</footer></body>"
    assert main_text(page).split("\n") == ["Title", *TEXT]


def test_sections_and_heading_in_body():
    page = f"<body>{MENU}<h1>Title</h1><section>{''.join(P[:3])}</section><section>{''.join(P[3:])}</section>{MENU}</body>"
    assert main_text(page).split("\n") == ["Title", *TEXT]


@pytest.mark.parametrize(
    "layout",
    [
        'class="content with-sidebar"',
        'class="has-banner"',
        'class="layout-no-sidebar"',
        'class="post social-share-enabled"',
        'id="search-result-article"',
        'class="sidebar"',
    ],
)
@pytest.mark.parametrize("kind", ["div", "section"])
def test_layout_classes_of_wrappers(layout, kind):
    page = f'<body><div class="nav-menu">menu</div><{kind} {layout}><h1>Title</h1>{"".join(P)}</{kind}><div class="footer">foot</div></body>'
    assert main_text(page).split("\n") == ["Title", *TEXT]


def test_layout_classes_of_parts():
    parts = "".join(f'<div class="post social-share-enabled">{p}</div>' for p in P)
    assert main_text(f"<body><div>{parts}</div></body>").split("\n") == TEXT


def test_heading_in_an_entry_header():
    for name in ("entry-header", "post-header", "header"):
        page = f'<body><article><div class="{name}"><h1>Title</h1></div>{"".join(P)}</article></body>'
        assert main_text(page).split("\n") == ["Title", *TEXT]


def test_marked_parts_still_go():
    off = ["ad", "site-footer", "ad-728", "sidebar-left", "comment-list", "related", "nav-menu", "x share"]
    parts = "".join(f'{p}<div class="{c}"><p>Out {c} of it.</p></div>' for p, c in zip(P, off)) + '<div role="search">find</div>'
    comments = f'<div id="comments"><article>{P[0]}</article></div>'
    assert main_text(f"<body><article><h1>T</h1>{parts}</article>{comments}</body>").split("\n") == ["T", *TEXT]


SHORT, LONGER = "A story of some plain words that is told here. " * 5, "Words of a reader who has much to say on that. " * 20


@pytest.mark.parametrize(
    "off",
    [
        '<div class="comment-list">{}</div>', '<ol class="commentlist"><li>{}</li></ol>', '<div id="cookie-banner">{}</div>',
        '<div class="gdpr-cookie-notice">{}</div>', '<div class="newsletter-signup">{}</div>', '<div class="related-articles">{}</div>',
        '<div class="adsbygoogle">{}</div>', '<div class="sponsored-content">{}</div>', "<div hidden>{}</div>", '<div style="color: red; display:none">{}</div>',
        '<section id="comments"><article>{}</article></section>',
    ],
)
@pytest.mark.parametrize("inside", [False, True])
def test_marked_parts_go_whatever_their_length(off, inside):
    part = off.format(f"<p>{LONGER}</p>")
    story = f"<article><h1>T</h1><p>{SHORT}</p>{part if inside else ''}</article>"
    for page in (f"<body>{story}{'' if inside else part}</body>", f"<body>{'' if inside else part}<div>{story}</div></body>"):
        assert main_text(page).split("\n") == ["T", SHORT.strip()]


def test_heading_in_the_articles_own_header():
    page = f'<body><header><p>Site</p></header><article><header class="entry-header"><h1>Title</h1></header>{"".join(P)}</article></body>'
    assert main_text(page).split("\n") == ["Title", *TEXT]
    assert main_text(page.replace("article>", "main>").replace("<article", "<main")).split("\n") == ["Title", *TEXT]


def test_a_marked_page_without_other_text_is_read():
    assert main_text(f'<body><div class="sidebar"><p>{LONGER}</p></div></body>') == LONGER.strip()

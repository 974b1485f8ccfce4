"""Containers are a prior of the block rules, not a whitelist."""

import pytest

from tallyframe.llm import html_extract

LONG = "the cat and the dog of the house is in the garden with a bird. " * 5
P = LONG.strip()
JUNK = "lorem | ipsum | dolor | amet | " * 10


@pytest.mark.parametrize(
    "html,text",
    [
        # the body of the page in plain blocks, a teaser in the article
        (f"<nav><a href=x>n</a></nav><div><p>{P}</p><p>{P}</p></div><article><h3><a href=y>Another story</a></h3></article>", f"{P} {P}"),
        (f"<div><h1>Head</h1><p>{P}</p><p>short one</p><p>{P}</p></div><article><a href=y>Another story to read</a></article>", f"Head {P} short one {P}"),
        # long prose beside the article stays, short lines and link lists do not
        (f"<article><p>{P}</p><p>{P}</p></article><div>{P}</div><div>Copyright</div><div><a href=x>more</a></div>", f"{P} {P} {P}"),
        # link lists inside the article go
        (f"<article><p>{P}</p><div><a href=x>all of this is a link text</a></div><p>{P}</p></article>", f"{P} {P}"),
        # blocks without stop words in an article stay only beside text
        (f"<article><p>{P}</p><p>{JUNK}</p><p>{P}</p></article>", f"{P} {JUNK.strip()} {P}"),
        (f"<article><p>{P}</p><div><a href=x>all of this is a link text</a></div><p>{JUNK}</p><div><a href=x>all of this is a link text</a></div></article>", P),
        # class words of the layout
        (f"<body class='no-sidebar'><article><h1>T</h1><p>{P}</p></article></body>", f"T {P}"),
        (f"<body class='no-sidebar'><p>{P}</p></body>", P),
        (f"<div class='page has-sidebar'><article><h1>T</h1><p>{P}</p></article></div>", f"T {P}"),
        (f"<div class='page has-sidebar'><main><h1>T</h1><p>word</p></main></div>", "T word"),
        (f"<form action=x><p>{P}</p><p>{P}</p></form><footer>f</footer>", f"{P} {P}"),
        # what stays out
        (f"<article><p>{P}</p><p>{P}</p></article><div class='comments'><p>{P}</p></div><aside><article>{P}</article></aside>", f"{P} {P}"),
        (f"<div hidden><p>{P}</p><p>{P}</p></div>", ""), (f"<article hidden>{P}</article><p>{P}</p>", P),
    ],
)
def test_containers_are_a_prior(html, text):
    assert html_extract.main_text(html) == text


def test_pages_without_marks_of_main_text():
    head = "<div class='top'><ul><li><a href=/a>Home</a></li><li><a href=/b>News of the day</a></li></ul></div>"
    foot = "<div><p>Copyright 2020</p><a href=/c>Terms of use</a> <a href=/d>Contact us</a></div>"
    body = f"<h1>The title</h1><p>{P}</p><p>A short line.</p><p>{P}</p><div><a href=x>Read more of this here</a></div><p>{P}</p>"
    for page in (f"<body>{head}<div>{body}</div>{foot}</body>", f"{head}<table><tr><td>{body}</td></tr></table>{foot}"):
        assert html_extract.main_text(page) == f"The title {P} A short line. {P} {P}"


def test_a_link_that_is_never_closed_ends_with_its_block():
    assert html_extract.main_text(f"<p>{P}</p><p><a href=x>lost link</p><p>{P}</p><p>{P}</p>") == f"{P} {P} {P}"


@pytest.mark.parametrize(
    "piece,times",
    [("<div>", 400_000), ("<div></span></section>", 90_000), ("<button>x", 220_000), ("<p>the of and x y z the of and x y</p>", 50_000), ("<h2>x</h2>", 200_000), ("<a href=x>t<p>", 140_000), ("<a", 1_000_000), ("<!--", 500_000)],
)
def test_a_large_broken_page_takes_linear_time(piece, times):
    import time

    began = time.process_time()
    html_extract.main_text(piece * times)
    assert time.process_time() - began < 8  # 2 MB; a second or two on an idle machine

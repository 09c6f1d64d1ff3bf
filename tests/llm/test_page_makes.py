"""Main text of pages of many makes, none of which the tree's table was written from."""

from __future__ import annotations

from collections import Counter

import pytest

from lorekeep.llm import html_blocks

LONG = [
    "The harbour office moved the evening readings to the north pier after the old gauge had drifted by almost a hand.",
    "Pilots who bring the larger ships in say that the new figures agree with what they see from the bridge, at least in calm weather.",
    "In winter the ice pushes the gauge against the wall, so a second one was set on the breakwater and both are read at noon.",
]
BODY = f"<h1>Gauges of the north pier</h1><p>{LONG[0]}</p><p>{LONG[1]}</p><p>So it stays.</p><p>{LONG[2]}</p>"
TEXT = ["Gauges of the north pier", LONG[0], LONG[1], "So it stays.", LONG[2]]
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li><li><a href=/about>About us</a></li></ul>"
READER = "I have read the gauge myself for twenty years and I can tell you that it never drifted before the new wall was built there."

MAKES = {
    "bare article": f"<html><body><nav>{MENU}</nav><article>{BODY}</article><footer><p>All rights reserved by the harbour office.</p></footer></body></html>",
    "no head end, no body": f"<html><head><title>Gauges</title><meta charset=utf-8><article>{BODY}</article>",
    "no head end, div first": f"<html><head><title>Gauges</title><link rel=x href=y><div class=content>{BODY}</div>",
    "blog post classes": f"<div class='post hentry category-legal tag-search tag-comments'>{BODY}</div>",
    "share-enabled wrapper": f"<div id=content class='share-enabled'>{BODY}</div>",
    "menu-open wrapper": f"<div class='site-menu-open'><div class=content>{BODY}</div></div>",
    "popup-active body wrapper": f"<div class='popup-active cookie-notice-visible'><header><h2>Port news</h2>{MENU}</header><div class=story>{BODY}</div></div>",
    "unclosed button": "<article>" + BODY.replace("</p><p>So", " <button>Like<p>So") + "</article>",
    "unclosed select": "<article>" + BODY.replace("</p><p>So", " <select><option>one<option>two<p>So") + "</article>",
    "unclosed object": "<article>" + BODY.replace("</p><p>So", " <object data=film.swf><p>So") + "</article>",
    "closed buttons": "<article>" + BODY.replace("<p>So", "<button type=button><div>Tell a friend</div></button><p>So") + "</article>",
    "reader thread behind": f"<article>{BODY}</article><div class=reader-thread><p>{READER}</p><p>{READER} And more of it.</p></div>",
    "reader voices in main": f"<main><article>{BODY}</article><section class=voices><p>{READER}</p><p>Me too, said another.</p></section></main>",
    "comments longer than the story": f"<div class=entry>{BODY}</div><div id=comments>" + f"<p>{READER}</p>" * 8 + "</div>",
    "disqus": f"<div class=post><div class=post-body>{BODY}</div></div><div id=disqus_thread class=comments><p>{READER}</p></div>",
    "table layout": f"<table><tr><td>{MENU}</td><td>{BODY}</td></tr></table>",
    "loose divs": f"<div><div>{MENU}</div><div>{BODY}</div><div>Imprint</div></div>",
    "open paragraphs": "<main><h1>Gauges of the north pier</h1><p>" + "<p>".join(TEXT[1:]) + "</main><footer>Port of somewhere</footer>",
    "sidebar right": f"<div class='page with-sidebar'><div class=main-col><article>{BODY}</article></div><div class=sidebar><h3>Most read</h3>{MENU}</div></div>",
    "cookie banner": f"<div class=cookie-banner><p>We use cookies to make this site better for you. Read more in our policy and accept.</p><button>Accept</button></div><main>{BODY}</main>",
    "modal and newsletter": f"<main>{BODY}</main><div class='modal newsletter-signup'><p>Subscribe to our weekly letter and never miss the news of the port again.</p></div>",
    "breadcrumbs and share bar": f"<div class=breadcrumbs><a href=/>Home</a> / <a href=/n>News</a></div><article>{BODY}<div class=share-bar><a href=a>Post</a> <a href=b>Mail</a></div></article>",
    "related inside the article": f"<article>{BODY}<aside class=related><h3>Read on</h3><p>Ships that were late, and why they were late this year again.</p></aside></article>",
    "advert between paragraphs": "<article>" + BODY.replace("<p>So", "<div class=advert><p>Buy the new barometer now, it is cheaper than ever before.</p></div><p>So") + "</article>",
    "hidden text": f"<article>{BODY}</article><div style='display:none'><p>{READER}</p></div><div hidden><p>{READER}</p></div>",
    "roles": f"<div role=banner><p>Port of somewhere, open every day from nine to five in the evening.</p></div><div role=main>{BODY}</div><div role=contentinfo>Imprint</div>",
    "section of sections": f"<section><section><header><h1>Gauges of the north pier</h1></header>{BODY.split('</h1>')[1]}</section></section>".replace("<section><header>", "<section class=article><header class=article-header>"),
    "script and style soup": f"<article><script>var a='<p>no</p>';</script><style>p{{color:red}}</style>{BODY}<noscript><p>Please enable scripts to see this page.</p></noscript></article>",
    "comment forms": f"<article>{BODY}</article><form action=/c><label>Name</label><input name=n><textarea>Write here what you think</textarea></form>",
    "header with a logo": f"<header class=site-header><a href=/><h2>Port news</h2></a></header><div class=article-body>{BODY}</div>",
    "legal notice": f"<div class=article>{BODY}</div><div class=disclaimer><p>The office takes no liability for errors in these figures or for any harm from their use.</p></div>",
    "skip links and pager": f"<a class=skip href=#c>Skip to content</a><div id=c class=content>{BODY}</div><div class=pagination><a href=1>1</a> <a href=2>2</a> <a href=3>Next</a></div>",
    "upper case tags": f"<BODY><DIV CLASS=NAV>{MENU}</DIV><DIV CLASS=STORY>{BODY}</DIV></BODY>",
    "amp": f"<html amp><head><noscript><style>x</style></noscript></head><body><amp-sidebar><nav>{MENU}</nav></amp-sidebar><main role=main>{BODY}</main></body></html>",
}


@pytest.fixture(scope="module")
def tree():
    return html_blocks.train_tree()


def test_precision_and_recall_over_all_makes(tree):
    kept = right = 0
    for page in MAKES.values():
        got = Counter(html_blocks.main_text(page, tree).split("\n"))
        kept, right = kept + got.total(), right + (got & Counter(TEXT)).total()
    assert len(MAKES) >= 30
    assert right / kept >= 0.95 and right / (len(TEXT) * len(MAKES)) >= 0.95


@pytest.mark.parametrize("make", list(MAKES)[:14])
def test_whole_article_and_nothing_else(tree, make):
    assert html_blocks.main_text(MAKES[make], tree).split("\n") == TEXT


def test_many_unclosed_elements_take_linear_time(tree):
    assert html_blocks.main_text("<article>" + "<button>x<p>y</p>" * 20_000 + "</article>", tree).count("y") == 20_000


def test_named_wrappers_within_each_other(tree):
    page = f"<div class=sidebar-wrap><div class=share-wrap><h1>{TEXT[0]}</h1><p>{LONG[0]}</p><p>{LONG[2]}</p></div><p>{LONG[1]}</p><div class=related><p>{READER}</p></div></div>"
    assert html_blocks.main_text(page, tree).split("\n") == [TEXT[0], LONG[0], LONG[2], LONG[1]]

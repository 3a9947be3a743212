"""Pages written and labelled by hand, in layouts that the generator does not make: what is main text stands between ‹ and ›."""

import re

from vellumark.llm import pages

BLOG = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>On kettles - My blog</title></head><body class="single">
<div id="page"><header id="masthead"><a href="/">My blog</a><nav id="site-navigation"><ul><li><a href="/about">About</a></li><li><a href="/archive">Archive</a></li></ul></nav></header>
<div id="content"><main><article class="post-12"><header class="entry-header"><h1 class="entry-title">‹On kettles›</h1></header>
<div class="entry-content"><p>‹A kettle is a vessel for boiling water, and most kitchens have one.›</p><h2>‹Materials›</h2>
<ul><li>‹Copper conducts heat well but needs care.›</li><li>‹Steel is cheap and lasts for decades.›</li></ul>
<blockquote><p>‹The best kettle is the one that is already warm.›</p></blockquote>
<p>‹In the end, any of them will make good tea if the water is fresh.›</p></div></article>
<div id="comments"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>I prefer glass kettles myself, they look better.</p></li><li class="comment"><p>Great post, thanks!</p></li></ol></div></main></div>
<aside id="secondary"><h2>Recent posts</h2><ul><li><a href="/a">On spoons</a></li><li><a href="/b">On forks</a></li></ul></aside>
<footer id="colophon"><p>Copyright 2022 My blog. All rights reserved.</p></footer></div></body></html>"""

NEWS = """<html><body><div class="topbar"><a href="/">Home</a> | <a href="/w">World</a> | <a href="/s">Sport</a></div>
<div class="cookie-banner"><p>We use cookies to improve your visit. Accept?</p><button>Accept</button></div>
<div class="story"><h1>‹Bridge reopens after long repair›</h1>
<div class="story-body"><p>‹The old bridge over the river was opened to traffic again on Monday, two years after it was closed.›</p>
<div class="ad-slot ad"><p>Buy new tyres today.</p></div>
<p>‹Engineers replaced more than four hundred rivets and painted the whole structure green, as it was in 1931.›</p>
<p>‹The mayor said that the costs had stayed within the budget.›</p></div></div>
<div class="related"><h3>More from this section</h3><ul><li><a href="/1">Tunnel closed at night</a></li><li><a href="/2">New ferry ordered</a></li></ul></div>
<div class="footer"><p>© 2023 The Daily. Privacy | Terms of use</p></div></body></html>"""

DOCS = """<html><body><nav class="toc"><ul><li><a href="#i">Install</a></li><li><a href="#u">Use</a></li><li><a href="#f">FAQ</a></li></ul></nav>
<main class="markdown-body"><h1>‹The tool›</h1><p>‹This tool renames files in a folder by a pattern that you give on the command line.›</p>
<h2>‹Install›</h2><pre>‹pip install tool›</pre><h2>‹Use›</h2><table><tr><th>‹Option›</th><th>‹Meaning›</th></tr><tr><td>‹-n›</td><td>‹only show what would be done›</td></tr></table>
<p>‹The formula <math><mi>x</mi><mo>+</mo><mn>1</mn></math> gives the number of the next file.›</p></main>
<footer>&copy; 2020 the authors &middot; MIT licence</footer></body></html>"""

FORUM_LIKE = """<html><body><div id="header"><h2>Site name</h2><form action="/search"><input name="q"><button>Search</button></form></div>
<div id="main"><div class="article"><h1>‹How to plant a tree›</h1><p>‹Dig a hole that is twice as wide as the roots and not deeper than they are long.›<p>‹Put the tree in, fill the hole with the same soil and water it well for the first weeks.›
<p>‹A stake keeps it upright while the roots grow.›</div>
<section id="disqus_thread"><h3>Discussion</h3><div class="reply"><b>anna</b> I did this last year and it works.</div><div class="reply"><b>ben</b> Mine died.</div></section></div>
<div id="sidebar"><h3>Newsletter</h3><p>Sign up for our newsletter to get garden tips.</p><form><input><button>Subscribe</button></form></div></body></html>"""

PLAIN = """<html><body><h1>‹Notes on rain›</h1><p>‹Rain falls when drops in a cloud grow too heavy to stay up.›</p><p>‹Small drops fall slowly, large ones fast, and very large ones break up.›</p><p>‹Most of them were ice at some height.›</p></body></html>"""

CASES = {"blog": BLOG, "news": NEWS, "docs": DOCS, "forum": FORUM_LIKE, "plain": PLAIN}


def judged():
    right = wrong = missed = exact = 0
    for page in CASES.values():
        want = [" ".join(re.sub(r"<[^>]*>", "", x).split()) for x in re.findall(r"‹(.*?)›", page, re.S)]
        got = pages.extract([re.sub("[‹›]", "", page)], pages.trained())[0].split("\n")
        right += sum(x in want for x in got)
        wrong += sum(x not in want for x in got)
        missed += sum(x not in got for x in want)
        exact += got == want
    return right, wrong, missed, exact


def test_layouts_by_hand():
    right, wrong, missed, exact = judged()
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.9 and exact >= 3


def test_long_blocks_are_measured_whole():
    text = "Words of a long paragraph, again and again, with stops. " * 200
    (short,), (long,) = (pages.describe([(t, 0, 0, len(t))]) for t in (text[:1120].strip(), text.strip()))
    assert abs(short - long).max() < 0.02


def test_nesting_costs_what_the_page_is_long():
    assert len(pages.blocks("<div>" * 50_000 + "x" + "<p>y</p>" * 10)) == 11
    assert len(pages.blocks("<b>" * 5000 + "<p>y</p><li>x" * 3000)) == 6000
    assert len(pages.blocks("<i><b>" * 3000 + "</u></p></i>" * 3000 + "end")) == 1


def test_only_form_fields_and_scripts_are_hidden():
    page = "<article><p>Code: <textarea>gone</textarea> and <math><mi>x</mi></math>, <svg><title>no</title><text>label</text></svg> <object>other</object> <noscript>still here</noscript> done.</p></article>"
    assert [b[0] for b in pages.blocks(page)] == ["Code: and x, label other still here done."]

"""Pages written by hand, of kinds that the training pages' generator doesn't write, with the article text that a reader would copy."""

import re
from collections import Counter

import pytest

from tallyloom.llm import html_text

PAGES = {
    "news": ("""<!doctype html><html lang=en><head><title>Bridge reopens - The Valley Post</title><style>p{margin:0}</style></head><body>
<div id="cookie-consent" class="banner">We use cookies to improve your visit. <a href="/privacy">Privacy policy</a> <button>Accept all</button></div>
<header class="site-header"><a href="/">The Valley Post</a><nav><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/weather">Weather</a></li></ul></nav></header>
<main><article class="story"><h1>Old bridge reopens after two years of repairs</h1>
<p>The stone bridge over the river opened to walkers on Monday, two years after a flood washed away its middle arch. The town paid for the works with a loan that it will repay over twenty years.</p>
<p>&ldquo;We missed it every day,&rdquo; said a baker whose shop stands at the northern end. Her customers had to take a detour of four miles.</p>
<div class="ad-slot">Advertisement: Fly to the sun from 49 a seat. Book now!</div>
<h2>A slow start</h2><p>Engineers first believed that the arch could be saved. When divers looked at the piers in the autumn, they found cracks as wide as a hand, and the plan was changed.</p>
<figure><img src="b.jpg" alt=""><figcaption>The bridge on the day of its opening.</figcaption></figure>
<p>Cars will have to wait until spring, when the new surface has settled.</p></article>
<aside class="related"><h3>Read more</h3><ul><li><a href="/1">Ten walks by the river</a></li><li><a href="/2">Flood warnings explained</a></li></ul></aside>
<section id="comments" class="comments"><h3>3 comments</h3><div class="comment"><b>anna</b><p>Finally! I walked over it this morning and it was lovely.</p></div><div class="comment"><b>joe</b><p>Too expensive if you ask me.</p></div></section></main>
<footer><p>&copy; The Valley Post. All rights reserved.</p><ul><li><a href="/about">About us</a></li><li><a href="/contact">Contact</a></li></ul></footer><script>track('page')</script></body></html>""",
        """Old bridge reopens after two years of repairs
The stone bridge over the river opened to walkers on Monday, two years after a flood washed away its middle arch. The town paid for the works with a loan that it will repay over twenty years.
“We missed it every day,” said a baker whose shop stands at the northern end. Her customers had to take a detour of four miles.
A slow start
Engineers first believed that the arch could be saved. When divers looked at the piers in the autumn, they found cracks as wide as a hand, and the plan was changed.
The bridge on the day of its opening.
Cars will have to wait until spring, when the new surface has settled."""),
    "blog of divs": ("""<html><body><div class="wrapper"><div class="topbar"><a href="/">Home</a> | <a href="/archive">Archive</a> | <a href="/about">About</a></div>
<div class="content"><div class="post"><h1>How I sharpen kitchen knives</h1><div class="entry-content">
<p>Start with a flat stone of about one thousand grit and soak it for ten minutes. A dry stone clogs, and the edge will burn instead of getting sharp.</p>
<p>Hold the blade at fifteen degrees. Count twenty strokes on one side, then twenty on the other, and check for a burr with your thumb.</p>
<ul><li>Never pull the edge towards your fingers.</li><li>Keep the stone wet all the time.</li><li>Finish on leather.</li></ul>
<blockquote>A dull knife is the most dangerous tool in the house.</blockquote>
<p>If the burr is even from heel to tip, change to a finer stone and repeat with half the pressure.</p></div>
<div class="share-buttons"><a href="#">Share</a> <a href="#">Tweet</a> <a href="#">Mail</a></div></div>
<div class="sidebar"><h4>Categories</h4><ul><li><a href="/c/1">Kitchen</a></li><li><a href="/c/2">Garden</a></li></ul><form class="search"><input name=q><button>Search</button></form></div></div>
<div id="footer">Powered by hand. Copyright 2020.</div></div></body></html>""",
        """How I sharpen kitchen knives
Start with a flat stone of about one thousand grit and soak it for ten minutes. A dry stone clogs, and the edge will burn instead of getting sharp.
Hold the blade at fifteen degrees. Count twenty strokes on one side, then twenty on the other, and check for a burr with your thumb.
Never pull the edge towards your fingers.
Keep the stone wet all the time.
Finish on leather.
A dull knife is the most dangerous tool in the house.
If the burr is even from heel to tip, change to a finer stone and repeat with half the pressure."""),
    "formulas": ("""<html><head><title>Roots</title></head><body><nav class="breadcrumbs"><a href="/">Start</a> &gt; <a href="/m">Mathematics</a></nav>
<article><h1>Square roots</h1><p>We call <math><mi>x</mi></math> the root of a number if <math><mrow><msup><mi>x</mi><mn>2</mn></msup><mo>=</mo><mi>a</mi></mrow></math> holds, and write it with the sign that you know from school.</p>
<p>Every positive number has two roots, which differ in their sign only; zero has one. For negative numbers there is none among the real ones.</p>
<noscript><p>The drawing below shows both branches.</p></noscript><p>The branch that is not negative is the one that the sign stands for.</p></article>
<div class="newsletter"><form action="/s"><p>Get one proof a week by mail.</p><input name=mail><button>Subscribe</button></form></div>
<footer>Imprint and legal notes</footer></body></html>""",
        """Square roots
We call x the root of a number if x2=a holds, and write it with the sign that you know from school.
Every positive number has two roots, which differ in their sign only; zero has one. For negative numbers there is none among the real ones.
The drawing below shows both branches.
The branch that is not negative is the one that the sign stands for."""),
    "unclosed": ("""<body><ul id=menu><li><a href=/>Start<li><a href=/b>Books</a><li><a href=/f>Films</a></ul><div id=main><h1>A quiet film about bees</h1>
<p>For ninety minutes nobody speaks. The camera stays with the keepers through a whole year, from the first warm day to the snow on the hives, and lets us listen.
<p>What could be dull is not, since every shot has its own small story. A queen is lost and found; a swarm hangs in a pear tree; a child learns not to run.
<p>Go and see it in a large room if you can.</div><div class=adverts>Win a trip for two! Click here</div><div id=legal>All rights reserved 1999</div>""",
        """A quiet film about bees
For ninety minutes nobody speaks. The camera stays with the keepers through a whole year, from the first warm day to the snow on the hives, and lets us listen.
What could be dull is not, since every shot has its own small story. A queen is lost and found; a swarm hangs in a pear tree; a child learns not to run.
Go and see it in a large room if you can."""),
}


def f1(a, b):
    x, y = (Counter(re.findall(r"\S+", t)) for t in (a, b))
    n = sum((x & y).values())
    return 2 * n / (sum(x.values()) + sum(y.values()))


@pytest.mark.parametrize("name", PAGES)
def test_article_text(name):
    page, article = PAGES[name]
    assert f1(html_text.main_texts([page], html_text.trained())[0], article) >= 0.95

"""Markup that real pages have: an open head, and classes that only mention a part."""

import random

import pytest

from terraza.llm import pages


@pytest.mark.parametrize("page", [
    "<html><head><meta charset=utf-8><title>t</title><body><p>Body",
    "<head><title>t</title><p>Body",
    "<head><title>t</title>Body",
    "<html><head><link href=x></head><body><p>Body</p></body></html>",
    '<main class="content-with-sidebar"><p>Body</p></main>',
    '<main class="sidebar"><p>Body</p></main><nav>n</nav>',
    '<article class="post has-comments"><p>Body</p></article>',
    '<article class="post has-sidebar"><p>Body</p></article>',
    '<article><div class="share-price">Body</div></article>',
    '<article><h2 class="entry-header">Body</h2></article>',
    '<div data-id="nav"><p>Body</p></div>',
    '<p><a href="/hidden-gems" title="the hidden truth">Body</a></p>',
    '<p>Body</p><span class="ad">x</span><p hidden>y</p>',
    '<div class="no-sidebar"><p>Body</p></div><div class="wide sidebar">x</div><div id="cookie-banner">y</div>',
])
def test_text_is_kept(page):
    assert pages.kept(pages.lines(page)) == ["Body"]


def brute(rows):
    """Texts by a plain search for each page's neighbours."""
    import re

    site = lambda u: re.match(r"(?:[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*))?", u or "")[1] or ""
    path = lambda u: (re.match(r"[A-Za-z][\w+.-]*://[^/?#]*([^#]*)", u or "") or ["", ""])[1]
    own = sorted(set(rows), key=lambda r: (site(r[1]), path(r[1]), r[0]))
    out = {}
    for k, r in enumerate(own):
        near = [own[j] for j in (k - 1, k + 1) if 0 <= j < len(own) and site(own[j][1]) == site(r[1])]
        same = lambda o: next((i for i, (x, y) in enumerate(zip(path(r[1]), path(o[1]), strict=False)) if x != y), min(len(path(r[1])), len(path(o[1]))))  # noqa: E731, B023
        found, gone = pages.lines(r[2]), set()
        if near:
            other = [t for t, _ in pages.lines(max(near, key=same)[2])]
            gone = {i for i in pages.shared_lines([t for t, _ in found], other) if found[i][1] == pages.OPEN and all(k != pages.OWN for _, k in found)}
        out[r] = "\n".join(pages.kept(found, gone))
    return out


def test_pairs_equal_a_plain_search(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        body = "".join(f"<p>{rng.choice('abcdefgh')}{rng.choice(['', i])}</p>" for _ in range(rng.randint(0, 7)))
        body = f"<article>{body}</article><nav>a</nav>" if rng.random() < 0.2 else body
        rows.append((i, f"http://{rng.choice('pqr')}.x/{rng.choice(['', 'd/', 'd/e/'])}{i:03d}", f"<div>Top</div>{body}<div>End</div>"))
    rows += rows[:5]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = brute(rows)
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted((r[0], want[r]) for r in rows)
    assert sum("Top" not in r["text"] for r in got) > 80

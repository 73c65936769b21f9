from collections import defaultdict

import numpy as np
import pytest
from helpers import CLASHING, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.html_blocks import ARTICLE, CONTENT, DROPPED, NEUTRAL, blocks
from millrace.llm.html_extraction import extract_main_text, kept_level, nodes


def kept(html, zone=ARTICLE):
    return [t for t, z in blocks(html) if z == zone]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<article><h1>A &amp; B</h1><p>one<br>two</p><p> three\n four </p></article>", ["A & B", "one two", "three four"]),
        ("<article><p><b>un<i>closed<p>next</article><p>after", ["unclosed", "next"]),
        ("<ARTICLE CLASS=x><P>a</P></ARTICLE>", ["a"]),
        ("<article><header><h1>t</h1></header><footer>f</footer><p>a</p><aside>s</aside><nav>n</nav></article>", ["t", "a"]),
        ("<article><p>a</p><div class='ad-box'>x</div><div class=\"comments\"><p>c</p></div><section id=comment-list>c</section></article>", ["a"]),
        ("<article><p>a<script>if (a<b) '</p>'</script>b</p><style>p{}</style><!-- <p>x</p> --></article>", ["ab"]),
        ("<article><form>f</form><p>a <a href='x>y'>link</a> b</p><button>z</button></article>", ["a link b"]),
        ("<article><p class='ad'>x<p>a</p></article>", ["a"]),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c</td><td>d</td></tr></table></article>", ["a", "b", "c d"]),
        ("<article class='comment'><p>c</p></article><article><p>a</p></article>", ["a"]),
        ("<article><p>a</p><div hidden>h</div><div role='complementary'>r</div></article>", ["a"]),
        ("<article><p>1 < 2 &lt;b&gt; &#233;&eacute;&nosuch;</p></article>", ["1 < 2 <b> éé&nosuch;"]),
        ("<article><p>a</p><script>never closed <p>b</p>", ["a"]),
        ("<article><p title='open>a</p><p>b</p></article>", ["a", "b"]),
    ],
)
def test_blocks(html, expected):
    assert kept(html) == expected


def test_zones():
    page = "<body class='no-sidebar'><div class='cookie-notice'>c</div><header>h</header><div id='main-content'><p>m</p></div><p>n</p><footer>f</footer></body>"
    assert blocks(page) == [("c", DROPPED), ("h", DROPPED), ("m", CONTENT), ("n", NEUTRAL), ("f", DROPPED)]
    assert blocks("") == [] and blocks("plain  text") == [("plain text", NEUTRAL)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<b>", "</b>", "<a href='", "'>", "<", ">", "<!--", "-->", "<script>", "</script>", "text ", "&amp;", "<article>", "</article>", "<br/>", "<li>"]), max_size=25))
def test_any_markup_is_read(parts):
    for text, zone in blocks("".join(parts)):
        assert text == " ".join(text.split()) and zone in (DROPPED, NEUTRAL, CONTENT, ARTICLE)


def test_unclosed_quotes_take_linear_time():
    assert len(blocks("<p>a</p>" + "<a title=\"" * 50_000)) >= 1


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 9), st.integers(1, 4))
def test_suffix_array_nodes(tokens, length, pages):
    tokens = np.array(tokens, np.uint64)
    page = np.sort(np.arange(len(tokens)) % pages)
    order, starts = nodes(tokens, page, length)
    found = {}
    for k, i in enumerate(order.tolist()):
        found.setdefault(int(np.searchsorted(starts, k, "right")), set()).add(i)
    want = {}
    for i in range(len(tokens) - length + 1):
        if page[i] == page[i + length - 1]:
            want.setdefault(tuple(tokens[i : i + length].tolist()), set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHING)) for r in rows], ", ".join(["page_id long", "url string", "html string", *(f"`{c}` string" for c in CLASHING)]))


def test_repeats_of_a_host_go(spark):
    notice = "all our readers are kindly asked to look at the notice below before they go on"
    rows = [(i, f"http://{'h' if i < 6 else 'other' + str(i)}.org/{i}", f"<div>{notice}</div><div>{prose(i, 30)}</div>") for i in range(9)]
    got = {r.page_id: r for r in extract_main_text(pages_of(spark, rows), shard_words=64).collect()}
    for i in range(9):
        want = prose(i, 30) if i < 6 else f"{notice}\n{prose(i, 30)}"
        assert got[i].text == want and got[i].n_chars == len(want)
        assert got[i].n_removed == (16 if i < 6 else 0)


def test_copies_of_a_page_are_no_repeats(spark):
    rows = [(1, "http://h.org/1", f"<div>{prose(1, 30)}</div>"), (2, "http://h.org/2", f"<div>{prose(1, 30)}</div>"), (2, "http://h.org/2", f"<div>{prose(1, 30)}</div>")]
    assert {r.text for r in extract_main_text(pages_of(spark, rows)).collect()} == {prose(1, 30)}


def brute(rows, length=8, share=0.5, most=0.5, least_texts=8):
    """Whole pages by plain loops over all substrings of a host."""
    parsed = []
    for _, url, html in rows:
        found = blocks(html or "")
        level = kept_level(found)
        main = [t for t, z in found if z == level]
        rest = [(t if z == NEUTRAL else "", t) for t, z in found if z < CONTENT]
        parsed.append((url.split("/")[2] if "://" in (url or "") else "", level >= CONTENT, main, rest, html))
    grams = lambda texts: [tuple(w[i : i + length]) for w in [" ".join(texts).split()] for i in range(len(w) - length + 1)]
    inside, outside, texts = defaultdict(set), defaultdict(set), defaultdict(set)
    for host, marked, main, rest, html in parsed:
        if marked:
            texts[host].add("\n".join(main))
            for g in grams(main):
                inside[host, g].add("\n".join(main))
        for g in grams([t for _, t in rest]):
            outside[host, g].add(html)
    out = []
    for host, marked, main, rest, _ in parsed:
        own = [(t, t) for t in main] if marked else rest
        found = grams([t for _, t in own])
        bad = [(len(inside[host, g]) >= max(least_texts, len(texts[host]) * most)) if marked else len(outside[host, g]) > 1 for g in found]
        hit = [any(bad[max(0, i - length + 1) : i + 1]) for i in range(sum(len(t.split()) for _, t in own))]
        kept, at = [], 0
        for t, counted in own:
            n = len(counted.split())
            if t and sum(hit[at : at + n]) < share * n:
                kept.append(t)
            at += n
        out.append("\n".join(kept))
    return out


def test_whole_pages_as_by_plain_loops(spark):
    slogan, quote = prose(900, 14), prose(901, 20)
    rows = []
    for i in range(60):
        host = ["a.org", "b.org", "c.org"][i % 3]
        menu = f"<nav>{prose(800 + i % 3, 10)}</nav>"
        parts = [f"<p>{prose(i, 30)}</p>", f"<p>{slogan}</p>" if i % 3 == 0 or i % 12 == 1 else "", f"<p>{quote}</p>" if i % 9 == 2 else "", f"<p>{prose(i + 300, 12)}</p>"]
        body = f"<article>{''.join(parts)}</article>" if i % 3 != 2 or i % 4 == 0 else f"<div>{''.join(f'<div>{p}</div>' for p in parts)}</div><div>{prose(700 + i % 2, 15)}</div>"
        rows.append((i, f"http://{host}/{i}", menu + body + "<footer>all rights reserved</footer>"))
    rows += [(100 + i, "http://b.org/copy", rows[1][2]) for i in range(9)]
    want = brute(rows)
    assert any(slogan in html and slogan not in t for (_, _, html), t in zip(rows, want)) and any(slogan in t for t in want) and any(quote in t for t in want)
    for options in ({}, {"shard_words": 100_000}):
        got = {r.page_id: r.text for r in extract_main_text(pages_of(spark, rows), **options).collect()}
        assert [got[r[0]] for r in rows] == want
    shards = {r.page_id: r.text for r in extract_main_text(pages_of(spark, rows), shard_words=300).collect()}
    assert [shards[r[0]] for r in rows] == want


def test_main_text_beside_teasers():
    page = f"<main><h1>t</h1><p>{prose(1, 60)}</p><article>read on</article></main>"
    assert kept_level(blocks(page)) == CONTENT and kept_level(blocks(f"<main>x<article>{prose(1, 60)}</article></main>")) == ARTICLE
    assert kept_level(blocks("<p>a</p>")) == NEUTRAL == kept_level([])


def test_articles_stay_whole_and_edges(spark):
    same = prose(5, 40)
    rows = [(1, "http://h.org/1", f"<article><p>{same}</p></article><p>x</p>"), (2, "http://h.org/2", f"<nav>{prose(6, 20)}</nav><article><p>{same}</p><p>é ☃</p></article>"), (3, None, None), (4, "", ""), (None, "no host", "<p>a b</p>"), (5, "http://h.org/5", "<article></article>"), (6, "http://h.org/6", "<p>" + "word " * 70_000)]
    got = {r.page_id: r for r in extract_main_text(pages_of(spark, rows)).collect()}
    assert got[1].text == same and got[2].text == f"{same}\né ☃" and got[2].n_chars == len(same) + 4
    assert [got[k].text for k in (3, 4, 5)] == ["", "", ""] and got[None].text == "a b"
    assert got[6].n_chars == 70_000 * 5 - 1
    assert extract_main_text(pages_of(spark, rows).limit(0)).count() == 0


def test_a_hot_hosts_shards_count_together(spark):
    """Shards of a text or two: notices that a shard has seldom or once, and a long page in many pieces."""
    rows = [(i, f"http://a.org/{i}", f"<article><p>{prose(i, 40)}</p>{f'<p>{prose(900, 14)}</p>' if i % 9 < 5 else ''}</article>") for i in range(45)]
    rows += [(100 + i, f"http://b.org/{i}", f"<article><p>{prose(i, 40)}</p>{f'<p>{prose(900, 14)}</p>' if i % 9 < 4 else ''}</article>") for i in range(45)]
    rows.append((200, "http://c.org/long", "<p>" + "word " * 140_000))
    got = {r.page_id: r.text for r in extract_main_text(pages_of(spark, rows), shard_words=60).collect()}
    assert [got[r[0]] for r in rows[:-1]] == brute(rows[:-1]) and not any(prose(900, 14) in got[i] for i in range(45))
    assert len(got[200]) == 140_000 * 5 - 1

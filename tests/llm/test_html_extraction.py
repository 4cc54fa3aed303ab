from __future__ import annotations

import random

import pytest

from hygroflow.llm import html_extraction as he

PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home {i}</a></li></ul></nav><div class="ad-box ad">Buy {i}</div>
<div id=story><h1>Title {i}</h1><p>First &amp; <b>bold</b>{i}<br>line&nbsp;two<p>Second &lt;{i}&gt; <!-- hidden --> a < b
<ul><li>x{i}<li>y</ul><p>All rights reserved by us.</div><section class="comments"><p>Nice {i}</p></section>
<aside>More {i}</aside><form><p>Mail {i}</p></form><footer>End {i}</footer>"""


def test_varying_text_is_content_and_constant_text_is_template():
    texts = he.extracted([PAGE.format(i=i) for i in range(10)])
    assert texts[3] == "Title 3\n\nFirst & bold3 line two\n\nSecond <3> a < b\n\nx3"


def test_an_article_is_taken_whole():
    page = "<body><div>Lead {i}</div><article><h1>H{i}</h1><div><p>A{i}</div><table><tr><td>c<td>d</table></article><p>after"
    assert he.extracted([page.format(i=7)]) == ["H7\n\nA7\n\nc\n\nd"]


def test_broken_and_deep_pages():
    deep = "<div>" * 5000 + "inside" + "</p></b>"
    assert he.extracted(["", "plain", deep, "<p>a<", "<script>x", "<p a='>b", "<!-- open"]) == ["", "plain", "inside", "a<", "", "b", ""]


def test_groups_of_hosts(spark):
    rows = [(i, f"http://h{i % 2 if i < 300 else i}.org/{i}", PAGE.format(i=i)) for i in range(310)]
    rows += [(900, None, None), (901, "http://h0.org/", ""), (5, "http://h0.org/x", PAGE.format(i=5)), (None, "x", "<p>t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = he.main_texts(df).collect()
    assert len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] == 5} == {"Title 5\n\nFirst & bold5 line two\n\nSecond <5> a < b\n\nx5"}
    assert [r["text"] for r in got if r["page_id"] in (900, 901)] == ["", ""]
    assert he.main_texts(df.limit(0)).count() == 0


def test_small_hosts_stay_whole_however_many_there_are(spark):
    page = "<div><p>Story {i} of this page</div><div><p>Welcome to our site.</div>"
    rows = [(i, f"http://hot.org/{i}", page.format(i=i)) for i in range(40_000)]
    rows += [(50_000 + i, f"http://h{i // 10}.org/{i}", page.format(i=i)) for i in range(300_000)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "page_id long, url string, html string")
    assert he.main_texts(df).where("text LIKE '%Welcome%'").count() == 0


def test_what_only_near_copies_share_is_not_template():
    story = "".join(f"<p>Paragraph {k} tells a part of the story." for k in range(5))
    page = "<div><p>Day {i}" + story + "</div><div><p>Terms of use.</div>"
    texts = he.extracted([page.format(i=i) for i in range(10)])
    assert all(f"Paragraph {k} tells" in t for t in texts for k in range(5))
    other = "<div><p>Item {i} has a text of its own, number {i}.</div><div><p>Terms of use.</div>"
    texts = he.extracted([page.format(i=i) for i in range(50)] + [other.format(i=i) for i in range(10)])
    assert all(f"Paragraph {k} tells" in t for t in texts[:50] for k in range(5))
    assert not any("Terms" in t for t in texts)


def test_long_and_deep_pages_are_aligned():
    section = "<h2>Head {i} {k}</h2><p>Text {i} {k} with some more words in it</p>"
    page = lambda i, n: "<div>" + "".join(section.format(i=i, k=k) for k in range(n)) + "<div>Terms of use.</div></div>"
    for sizes in ([150] + [5] * 9, [5] * 9 + [150], [150, 140, 160] * 4):
        texts = he.extracted([page(i, n) for i, n in enumerate(sizes)])
        assert not any("Terms" in t for t in texts)
        assert [t.count("Text") for t in texts] == sizes
    deep = "<div>" * 300 + "{p}<section><p>Story {i} of this page</section><section>Terms of use.</section>"
    texts = he.extracted([deep.format(i=i, p="<p>Lead {i}</p>" if i % 2 else "") for i in range(10)])
    assert not any("Terms" in t for t in texts)


def test_longest_common_order():
    import random

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = he.in_order(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def _pairs_by_definition(a, b, weights):
    """Size of the match of two trees and their pairs of runs, from the whole table of weighted alignment."""
    left, right = he.runs(a), he.runs(b)
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, (key, ours) in enumerate(left, 1):
        for j, (other, theirs) in enumerate(right, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1])
            if key == other:
                if (id(ours[0]), id(theirs[0])) not in weights:
                    weights[id(ours[0]), id(theirs[0])] = _pairs_by_definition(ours[0], theirs[0], weights)[0] + 1
                best[i][j] = max(best[i][j], best[i - 1][j - 1] + weights[id(ours[0]), id(theirs[0])])
    pairs, i, j = set(), len(left), len(right)
    while i and j:
        ours, theirs = left[i - 1], right[j - 1]
        if ours[0] == theirs[0] and best[i][j] == best[i - 1][j - 1] + weights[id(ours[1][0]), id(theirs[1][0])]:
            pairs.add((id(ours[1][0]), id(theirs[1][0])))
            pairs |= _pairs_by_definition(ours[1][0], theirs[1][0], weights)[1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1], pairs


def _random_html(rng, n, depth):
    out = ""
    for _ in range(n):
        below = _random_html(rng, rng.randrange(4), depth - 1) if depth and rng.random() < 0.5 else "t"
        out += f"<div class={rng.choice('abcd')}>{below}</div>"
    return out


def _matches_by_definition(first, second):
    a, b = he.parsed(first), he.parsed(second)
    size, top = he.matched(a, b)
    pairs, todo = set(), [top]
    while todo:
        for ours, theirs, below in todo.pop():
            pairs.add((id(ours[0]), id(theirs[0])))
            todo.append(below)
    return (size, pairs) == _pairs_by_definition(a, b, {})


def test_long_lists_are_matched_by_all_that_lies_below():
    rng = random.Random(4)
    first = _random_html(rng, 400, 2)
    tail = _random_html(rng, 40, 2)
    assert min(len(he.runs(he.parsed(x))) for x in (first, tail + first)) > 200
    assert _matches_by_definition(first, _random_html(rng, 400, 2))
    assert _matches_by_definition(first, tail + first[:4000] + tail + first[4000:] + tail)
    # a long list that is not the whole page
    assert _matches_by_definition(f"<div>{tail}</div><p>x</p><div>{first}</div>", f"<div>{first}{tail}</div><p>y</p><div>{tail}</div>")


@pytest.mark.parametrize("slack", [1, 5, 256])
def test_the_band_of_an_alignment_holds_its_pairs(slack, monkeypatch):
    monkeypatch.setattr(he, "LARGE", 0)
    monkeypatch.setattr(he, "SLACK", slack)
    monkeypatch.setattr(he, "REMEMBERED", 10)
    for seed in range(60):
        rng = random.Random(seed)
        first = _random_html(rng, rng.randrange(25), 3)
        assert _matches_by_definition(first, _random_html(rng, rng.randrange(25), 3))
        assert _matches_by_definition(first, _random_html(rng, 3, 2) + first + _random_html(rng, 2, 2))


def test_template_in_long_lists_is_found_by_what_lies_below():
    rest = "".join(f"<h2>Head {{i}} {k}</h2><p>Text {{i}} {k}</p>" for k in range(125))
    light = "<section><h4>Lead {i}</h4></section><h3>Note {i}</h3>"
    page = "<section><ul><li>Terms of use.</ul><table><tr><td>Offer {i}</table></section>" + rest
    texts = he.extracted([(light * (i % 2) + page).format(i=i) for i in range(10)])
    assert not any("Terms" in t for t in texts)
    assert all(f"Offer {i}" in t and t.count("Text") == 125 for i, t in enumerate(texts))


def test_shapes_that_are_forgotten_change_nothing(monkeypatch):
    rng = random.Random(1)
    pages = [_random_html(rng, 30, 2) + "<p>Terms of use.</p>" for _ in range(12)]
    texts = he.extracted(pages)
    monkeypatch.setattr(he, "SHAPES", 3)
    monkeypatch.setattr(he, "ROWS", 1)
    assert he.extracted(pages) == texts

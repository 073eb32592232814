"""Page text: parsing cases, templates against plain occurrence vectors, unusual rows."""

from collections import Counter, defaultdict

import pytest

from flowscape.llm import webtext

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "page, text",
    [
        ('<html><head><title>t</title></head><body><nav>menu</nav><div class="cookie-notice">ok?</div><article><h1>A &amp; B</h1><p>one\n two<p>three<div class="comments"><p>no</p></div></article><footer>f</footer>', "A & B\n\none two\n\nthree"),
        ('<article><p class="x>hello</p><p>b</p></article>', "hello\n\nb"),
        ('<p title="a > b">q</p>', "q"),
        ('<article><header class="entry-header"><h1>T</h1></header><p>a</p></article>', "T\n\na"),
        ('<header><h1>site</h1></header><article><p>a</p></article>', "a"),
        ('<article><p>a <span class="ad">x</span> b</p></article>', "a b"),
        ('<article><p>a</p><div class="ad">x</div><p>b</p></article>', "a\n\nb"),
        ('<article><noscript>n</noscript><math><mi>x</mi></math><object>o</object></article>', "n\n\nx\n\no"),
        ('<article><div class="social">s</div><ul class="menu"><li>m</li></ul></article>', "s\n\nm"),
        ('<article>f <form>x<select><option>y</select></form><script>var t="</p>";</script>g</article>', "f\n\ng"),
        ('<div id="content"><p>' + "story " * 40 + "</p></div><article>teaser</article>", "story " * 39 + "story\n\nteaser"),
        ("<article>1<br>2 <b>3<i>4</b></i>&nbsp;&#x41;&eacute;</article>", "1 2 34 Aé"),
        ("<p>cut off <b", "cut off"),
        ("a < b", "a < b"),
        ("", ""),
    ],
)
def test_page(page, text):
    assert webtext.main_text(page)[0] == text


def _site(k, words="story"):
    return f'<html><body><div class="top"><p>Our site</p></div><article><h1>Title {k}</h1><p>{words} {k} ' + "word " * 30 + f'</p><p class="share">Share this</p></article><div><p>Made by us</p></div></body></html>'


def test_template_texts_go_wherever_they_stand(spark):
    rows = [(k, f"http://one.example/{k}", _site(k)) for k in range(6)]
    rows += [(10 + k, f"http://two.example/{k}", _site(k)) for k in range(2)]  # too few pages
    rows += [(20 + k, f"http://three.example/{k}", _site(7)) for k in range(5)]  # copies of one page
    got = {r.page_id: r for r in webtext.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    body = lambda k: f"Title {k}\n\nstory {k} " + " ".join(["word"] * 30)
    for k in range(6):
        assert got[k].text == body(k) and got[k].n_chars == len(body(k)) and got[k].n_template >= 8
    for k in range(2):
        assert got[10 + k].text == body(k) + "\n\nShare this" and got[10 + k].n_template == 0
    for k in range(5):
        assert got[20 + k].text == body(7) + "\n\nShare this"


def test_vectors_equal_plain_ones(spark):
    rows = [(k, "http://h.example/", _site(k, "news" if k % 3 else "story")) for k in range(7)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("page_id as row", "1L as host", "html")
    got = {r.token: r for r in webtext.templates(df).collect()}
    counts, tags = defaultdict(dict), {}
    for k, _, html in rows:
        for x, n in Counter(x for x, _ in webtext.named(webtext.tokens(html))).items():
            counts[x][k] = n
        tags |= dict(webtext.named(webtext.tokens(html)))
    frequent = {x: v for x, v in counts.items() if len(v) >= max(webtext.LEAST, webtext.SHARE * len(rows))}
    assert set(got) == {x for x, v in frequent.items() if frequent.get(tags[x]) == v}
    classes = defaultdict(set)
    for x, r in got.items():
        classes[r.vector].add(tuple(sorted(counts[x].items())))
    assert all(len(v) == 1 for v in classes.values())


def test_classes_must_be_ordered_and_nested():
    known = {1: (5, 0.0, 6), 2: (5, 4.0, 6), 3: (6, 1.0, 5), 4: (6, 2.0, 5), 5: (7, 3.0, 4), 6: (7, 5.0, 4)}
    assert webtext.template_of([1, 3, 4, 2], known) == {0, 1, 2, 3}
    assert webtext.template_of([2, 3, 4, 1], known) == {1, 2}  # class 5 is out of order
    assert webtext.template_of([1, 5, 2, 6], known) == {0, 2}  # class 7 crosses class 5
    assert webtext.template_of([9, 9], known) == set()


def test_unusual_rows(spark, monkeypatch):
    rows = [(1, None, None), (1, None, None), (None, "x", "<p>a"), (2, "http://h/", ""), (3, "http://h/", "<p>" + "long " * 200_000)]
    rows += [(30 + k, "http://one.example/", _site(k)) for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as host", "2 as row", "'t' as template", "'x' as text")
    first = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in webtext.extract(df).collect())
    assert [r[2] for r in first[:4]] == ["a", "", "", ""] and first[4][3] == 5 * 200_000 - 1
    monkeypatch.setattr(webtext, "SENT", 0)  # the same by a join
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in webtext.extract(df).collect()) == first
    assert webtext.extract(df.limit(0)).count() == 0

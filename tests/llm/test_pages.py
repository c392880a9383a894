import time

import numpy as np
import pytest

from mailgrade.llm import markup, pages

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def run(spark, rows):
    frame = spark.createDataFrame([(i, u, h, "t", "n") for i, (u, h) in enumerate(rows)], SCHEMA)
    got = {r["page_id"]: r for r in pages.main_text(frame).collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and len(got) == len(rows)
    return [got[i]["text"] for i in range(len(rows))]


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>if (a<b) "</p>";</script></head><body class="menu"><nav><ul><li><a href="/">Home</a></li></ul></nav>'
    '<header>Site</header><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>'
    "<article><header><h1>Fish &amp; chips</h1></header><p>One\n  two&nbsp;three <b>bold</b>er<br>line<p>Open <i>para</i>"
    '<form><input value=x><button>Go</button></form><aside>Side</aside><div class="share">Share</div><ul><li>first<li>second</ul><p hidden>no'
    '</p><style>p{}</style><!-- <p>gone</p> --><table><tr><td>a<td>b</table></article>'
    '<section id="comments"><article class="comment"><p>Nice!</p></article></section><footer>&copy; me</footer></body></html>'
)


def test_declared_article(spark):
    text = "Fish & chips\nOne two three bolder\nline\nOpen para\nfirst\nsecond\na\nb"
    assert run(spark, [("http://h/1", PAGE), (None, PAGE), ("http://h/1", None), ("http://h/1", ""), ("x", "plain words &lt;here")]) == [
        text, text, "", "", "plain words <here"
    ]


@pytest.mark.parametrize("html", ["<", "<p", "a < b", "<p class='x>never", "<script>", "</div></p>text", "<!--", "&#xFFFFFF;&bogus;", "<p>" * 3000, "\x00"])
def test_broken_markup_does_not_fail(spark, html):
    assert isinstance("\n".join(b.text for b in markup.blocks(html)), str)


def test_repeated_runs_on_a_host_are_boilerplate(spark):
    top = "<div>Acme news the best site in the whole wide world of sites</div><div>Sections world sport culture</div>"
    end = "<div>Contact us by mail or by phone on any day of the week</div>"
    own = [" ".join(f"word{k}x{j}" for j in range(30)) for k in range(4)]
    rows = [("http://acme.org/%d" % k, f"<body>{top}<div>{t}</div>{end}</body>") for k, t in enumerate(own)]
    rows += [("http://other.org/a", f"<body>{top}<div>{own[0]}</div></body>"), ("http://copy.org/1", f"<body>{own[1]}</body>"), ("http://copy.org/2", f"<body>{own[1]}</body>")]
    got = run(spark, rows)
    assert got[:4] == own
    assert got[4].endswith(own[0]) and "Acme news" in got[4]  # nothing repeats on that host
    assert got[5] == got[6] == own[1]  # two copies are one distinct page


def test_suffix_classes_against_all_pairs():
    r = np.random.default_rng(2)
    streams = [r.integers(0, 3, n).astype(np.uint64) for n in (0, 3, 8, 20, 40, 9)]
    rank, which, place = pages.suffix_classes(streams, 5)
    grams = [tuple(streams[w][p : p + 5]) for w, p in zip(which, place)]
    assert len(grams) == sum(max(0, len(s) - 4) for s in streams)
    for i in range(len(grams)):
        for j in range(i):
            assert (rank[i] == rank[j]) == (grams[i] == grams[j])


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("text", [
    "<a " * 330_000, "<div>" * 200_000, "<a title=\"" * 100_000, "<a b='c" * 140_000 + ">", "<nav><article>" * 70_000, "<b>" * 300_000 + "<p>" * 30_000,
    "<" * 1_000_000, "<!--" * 250_000, "<script></scriptx" * 60_000, "<div>" * 100_000 + "</p>" * 100_000, "&amp" * 250_000,
], ids=lambda t: t[:16])
def test_a_megabyte_of_broken_markup_takes_no_time(text):
    started = time.process_time()
    markup.blocks(text)
    assert time.process_time() - started < 10


@pytest.mark.parametrize("mark", ['section id="discussion"', 'section id="related-work"', 'div class="popular-culture"', 'p class="notice-period"'])
def test_sections_of_an_article_stay(mark):
    found = markup.declared_article(markup.blocks(f"<article><p>one two</p><{mark}><p>three four</p></{mark.split()[0]}></article>"))
    assert [b.text for b in found] == ["one two", "three four"]


@pytest.mark.parametrize("mark", ['div class="social-share"', 'div class="related-posts"', 'section class="comments"', 'div class="newsletter"'])
def test_chrome_in_an_article_goes(mark):
    found = markup.declared_article(markup.blocks(f"<article><p>one two</p><{mark}><p>three four</p></{mark.split()[0]}></article>"))
    assert [b.text for b in found] == ["one two"]


def test_every_post_of_a_page_stays_but_no_list_of_links():
    page = "<article><p>a long first post of many words</p></article><article><p>short</p></article><article><a href='x'>elsewhere</a></article>"
    assert [b.text for b in markup.declared_article(markup.blocks(page))] == ["a long first post of many words", "short"]


def test_repeated_blocks_inside_articles_go_and_quotations_stay(spark):
    share = "Tell your friends about this story on all of the usual networks today"
    quote = " ".join(f"quoted{j}" for j in range(12))
    own = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(6)]
    pages_ = [f"<article><h1>Title {k}</h1><p>{t}</p>{'<p>' + quote + '</p>' if k < 2 else ''}<p>{share}</p><p>Read more</p></article>" for k, t in enumerate(own)]
    got = run(spark, [(f"http://acme.org/{k}", h) for k, h in enumerate(pages_)])
    assert got == [f"Title {k}\n{t}" + (f"\n{quote}" if k < 2 else "") for k, t in enumerate(own)]
    # On hosts of their own, and in copies or near copies of one article, nothing is boilerplate.
    alone = run(spark, [(f"http://h{k}.org/", h) for k, h in enumerate(pages_)])
    assert all(t.endswith(f"{share}\nRead more") for t in alone)
    copies = [f"<article><p>{own[0]}</p><p>version {k}</p></article>" for k in range(4)] + [f"<article><p>{own[1]}</p></article>"] * 4
    assert run(spark, [("http://c.org/%d" % k, h) for k, h in enumerate(copies)]) == [f"{own[0]}\nversion {k}" for k in range(4)] + [own[1]] * 4

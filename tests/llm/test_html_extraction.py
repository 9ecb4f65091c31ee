import html
import re

from stationlake.llm import html_extraction as H


def expected(page):
    """The article's blocks of the synthetic pages, by their one layout."""
    core = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h\d|ul|li)\b[^>]*>", core)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_whole_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = H.query(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == expected(pages[r.page_id]) and r.n_chars == len(r.text)


def test_held_out_layouts():
    """Pages of other seeds than the training ones: labels of blocks."""
    right = total = 0
    for page in H.training_pages(60, seed=99):
        blocks = H.leaf_blocks(page)
        rows = [H.features(t, s, k, i, len(blocks)) for i, (t, s, k) in enumerate(blocks)]
        for (_, s, _), label in zip(blocks, H.trained().decode(rows)):
            right += label == int(s[2])
            total += 1
    assert right / total > 0.97


def test_viterbi_by_brute_force():
    import itertools

    field, rows = H.trained(), []
    for t in ["in:nav", "in:article", "own:p", "own:li", "in:footer", "own:h1"]:
        rows.append([t, "words:3"])
    s = field.scores(rows)
    score = lambda y: sum(s[i, y[i]] for i in range(len(y))) + sum(field.move[a, b] for a, b in zip(y, y[1:]))
    assert field.decode(rows) == list(max(itertools.product((0, 1), repeat=len(rows)), key=score))


def test_handmade(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body><header><nav><a href=/>Home</a></nav></header>
    <div class="cookie-notice"><p>We use cookies. Accept them all.</p></div><main><article><h1>A  title &amp; more</h1><p>First&nbsp;paragraph with <i>some</i> words &lt;b&gt; in it, and a few more.
    <p>Second paragraph, quite   long enough to be read as text of the article.<br>After a break.</article>
    <section class="comments"><h2>Comments</h2><div class="comment"><p>Nice article, thank you very much for it.</p></div></section></main>
    <aside class="sidebar"><p>Latest news from around the world.</p></aside><form><label>Email</label><button>Send</button></form><footer>&copy; 2024</footer></body></html>"""
    want = "A title & more\nFirst paragraph with some words <b> in it, and a few more.\nSecond paragraph, quite long enough to be read as text of the article. After a break."
    long = "<article>" + "<p>Some longer sentence of a very long article here.</p>" * 5000 + "</article>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", long), (4, "u", "<nav><a>x</a></nav>"), (1, "u", page), (5, "u", "<article><p>Cut off in the middle of this long sen<a hr")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as n_chars")
    got = {r.page_id: r.text for r in H.extract_pages(df).collect()}
    assert got[1] == want and got[2] == got[3] == got[4] == ""
    assert got[None].count("\n") == 4999
    assert H.extract_pages(df.limit(0)).collect() == []


def test_odd_pages_take_linear_time():
    import time

    start = time.time()
    for page in ("<a " * 300_000, '<a "' * 300_000 + ">", "<div>a b " * 100_000, "<div>" * 100_000 + "x", "</div" * 200_000, "<!--" * 300_000, "<script></script" * 60_000, "<p title='" * 100_000, "< " * 500_000, "<p>x</q>" * 100_000, "<svg>x" * 100_000, "<é>" * 200_000):
        H.main_text(page, H.trained())
    assert time.time() - start < 40


def test_odd_markup_costs_no_text_and_gives_none():
    texts = lambda page: [t for t, *_ in H.leaf_blocks(page)]
    assert texts('<p>a <é b<p title="x > y">c</p>') == ["a <é b", "c"]
    assert texts('<p>one<p class="x > y">three</p><p title="never closed>two</p><p>four') == ["one", "three", "two", "four"]
    for tag in ("svg", "object", "canvas", "video", "audio", "math", "noscript"):
        assert texts(f"<p>a</p><{tag}><p>b</p><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["where x=2 holds"]
    assert texts("<p>a<svg><text>drawn</text></svg>b</p><p>c</p><script>var x = '<p>no</p>'") == ["ab", "c"]
    assert texts("<p>a</p><script>x</scripts></script ><p>b</p>") == ["a", "b"]

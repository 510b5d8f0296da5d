import html as entities
import re

import numpy as np
import pandas as pd

from tessera.llm import html_text


def plain_extract(page):
    """What the generator of the pages puts in: heading and paragraphs of the article."""
    a = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    a = re.sub(r"<[^>]*>", " ", re.sub(r"</?(p|h1)>", "\n", a))
    return "\n".join(b for b in (" ".join(entities.unescape(x).split()) for x in a.split("\n")) if b)


def test_query_against_plain_extraction(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.op6_html_suffix_array(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == plain_extract(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_markup():
    page = """<html><head><title>T &amp; t</title></head><body><header>Top</header><nav><a>Home</a></nav><main><header><h1>A &lt;b&gt;
      title</h1></header><p>One<br>two&nbsp;x <b>th</b>ree</p><script>if (a<b) {"</p>"}</script><!-- <p>no</p> --><div class='ad-box'>Buy</div>
      <ul><li>i<li>ii</ul><form><p>mail</p></form><section id="comments"><p>First!</p></section><table><tr><td>a<td>b</table>&#233;t&eacute;
      <aside><div>side</div></aside><p hidden>none</p><p style="display: none">none</p></main><div class="cookie-notice">ok?</div>
      <footer>foot</footer></body></html>"""
    assert html_text.main_text(html_text.blocks(page)) == "A <b> title\nOne two x three\ni\nii\na b\nété"


def text_of(page):
    return html_text.main_text(html_text.blocks(page))


def test_names_do_not_take_the_article():
    for wrapper in ('div class="layout with-sidebar"', 'div class="page no-banner"', "form action=x", 'div class="sidebar-right"', 'section id="widget"'):
        tag = wrapper.split()[0]
        assert text_of(f"<body><{wrapper}><div class=ads>Buy</div><article><p>Story</p></article><p>else</p></{tag}></body>") == "Story", wrapper
        assert text_of(f"<body><{wrapper}><div role=main><p>Story</p><form>mail</form></div></{tag}><footer>f</footer></body>") == "Story", wrapper
    kept = ('<article><section id="related-work"><h2 id="social-impact">Impact</h2><p>a</p></section><h2 id="cookies">Cookies</h2><p class="share-price">b</p>'
            '<section id="cookies"><p>c</p></section><div class="ad-hoc">d</div></article>')
    assert text_of(kept) == "Impact\na\nCookies\nb\nc\nd"
    gone = ('<article><p>a</p><div class="ad-box top">x</div><div class="social-share-buttons">x</div><div id="disqus_thread">x</div><div class="related-posts">'
            '<article>teaser</article></div><ol class="comment-list"><li><article>first!</article></ol></article><div class="related"><article>x</article></div>')
    assert text_of(gone) == "a"


def test_left_out_end_tags():
    assert text_of('<article><p class="notice">n<p>one</p><p>two</article>') == "one\ntwo"
    assert text_of('<article><p class="notice">n<div>one</div><h2>two</h2></article>') == "one\ntwo"
    assert text_of('<article><div><p class="notice">n</div>one</article>') == "one"
    assert text_of('<article><ul><li class="share">s<li>one<li>two</ul><p>three</article>') == "one\ntwo\nthree"
    assert text_of('<article><ul><li class="share">s<ul><li>t</ul>u<li>one</ul></article>') == "one"
    assert text_of('<article><dl><dt class="ad">s<dd>one<dd class="ad">t<dt>two</dl></article>') == "one\ntwo"
    assert text_of('<article><table><tr class="ad"><td>s<tr><td>a<td class="ad">t<td>b<tr><td>c</table></article>').split() == ["a", "b", "c"]
    assert text_of('<html><head><title>t</title><body><article><p>one<span class="ad">x<p>two</article>') == "one\ntwo"
    assert text_of("<div><article>one</div><p>two</article>") == "one\ntwo"


def test_broken_markup():
    assert html_text.main_text(html_text.blocks("<article><p>one <b>two<p>three &am")) == "one two\nthree &am"
    assert html_text.main_text(html_text.blocks("<article><p title=\"a>b\">x</p><p class='c>y</p> z")) == "x\ny\nz"
    assert html_text.main_text(html_text.blocks("plain text & more <")) == "plain text & more <"
    assert html_text.main_text(html_text.blocks("<nav>menu")) == ""
    assert html_text.main_text(html_text.blocks("<script>never closed <p>x")) == ""


def test_suffix_order_sorts_by_the_first_tokens():
    rng = np.random.RandomState(0)
    tokens = rng.randint(0, 3, 200).astype(np.uint64)
    order, new = html_text.suffix_order(tokens, 6)
    keys = [tuple(tokens[i:i + 6]) for i in order]
    assert keys == sorted(keys)
    assert [bool(b) for b in new] == [True] + [a != b for a, b in zip(keys, keys[1:])]


def site(spark):
    menu = "<div>Home News Sport Weather Travel Contact us today</div>"
    legal = "<div>All rights reserved by the owner of this fine site</div>"
    rows = [(i, f"http://Host.example/{i}", f"<body>{menu}<div>Story {i} tells{i} of x{i} unique y{i} things z{i} that v{i} happened.</div>{legal}</body>")
            for i in range(8)]
    rows += [(100, "http://other.example/", f"<body>{menu}<p>Short</p></body>"), (101, None, None), (102, "http://host.example/e", "")]
    rows += [rows[0], (103, "http://host.example/a", "<body><article><p>All rights reserved by the owner of this fine site</p></article></body>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute_repeats(streams, pages=html_text.MIN_PAGES, n=html_text.MIN_RUN):
    """Runs on enough distinct pages, by looking at every window."""
    seen = {}
    for key, tokens in streams.items():
        for i in range(len(tokens) - n + 1):
            seen.setdefault(tuple(tokens[i:i + n].tolist()), set()).add(key)
    return {run for run, keys in seen.items() if len(keys) >= pages}


def test_repeated_runs_of_a_host_go_and_unique_runs_stay(spark):
    rows = {r["page_id"]: r["text"] for r in html_text.extract(site(spark)).collect()}
    for i in range(8):
        assert rows[i] == f"Story {i} tells{i} of x{i} unique y{i} things z{i} that v{i} happened."
    assert rows[100] == "Home News Sport Weather Travel Contact us today\nShort"  # not repeated on its host
    assert rows[103].startswith("All rights reserved")  # inside an article
    assert rows[101] == "" and rows[102] == ""
    assert html_text.extract(site(spark)).count() == 13


def test_two_pages_are_a_repeat(spark):
    menu = "<div>Home News Sport Weather Travel Contact us today</div>"
    rows = [(i, "http://two.example/", f"<body>{menu}<div>Story {i} of x{i} unique y{i} things z{i}</div></body>") for i in (1, 2, 2)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["text"] for r in got) == [f"Story {i} of x{i} unique y{i} things z{i}" for i in (1, 2, 2)]


def test_shards_add_up_to_one_array(spark):
    pages = [(f"p{i}", f"<div>a b c d e f g h</div><div>only {i} here x{i} y{i}</div>" + ("<div>k l m n o p</div>" if i % 2 else "")) for i in range(9)]
    streams = {k: html_text._stream(html_text.blocks(h)) for k, h in pages}
    want = {html_text.run_hashes(np.array(run, dtype=np.uint64)).view(np.int64)[0] for run in brute_repeats(streams)}
    rows = [("h", i, len(s), s.tobytes()) for i, s in enumerate(streams.values())]
    df = spark.createDataFrame(rows, "host string, page long, n long, tokens binary")
    for size in (25, 10_000):
        assert {r["run"] for r in html_text.repeated_runs(df, shard_tokens=size).collect()} == want


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "no host", "<p>x</p>", 2), (1, "no host", "<p>x</p>", 2), (2, "http://a.b", "<p>" + "y " * 100_000, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(df).collect()
    assert len(got) == 4 and sorted(r["n_chars"] for r in got) == [0, 1, 1, 199_999]
    assert html_text.extract(df.where("false")).collect() == []


def test_formulas_are_text_and_their_annotations_are_not():
    page = ("<html><body><article><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup>"
            "<annotation encoding='application/x-tex'>E=mc^2</annotation></math> holds.</p></article></body></html>")
    assert html_text.main_text(html_text.blocks(page)) == "Energy E=mc2 holds."


def test_suffix_array_orders_whole_suffixes_with_their_common_prefixes():
    rng = np.random.RandomState(5)
    for tokens in (rng.randint(0, 3, 200), np.zeros(40, int), np.tile(rng.randint(0, 5, 30), 4), np.array([7])):
        tokens = tokens.astype(np.uint64)
        order, shared = html_text.suffix_array(tokens)
        tails = [tokens[i:].tolist() for i in order]
        assert tails == sorted(tails) and sorted(order) == list(range(len(tokens)))
        want = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(tails, tails[1:])]
        assert shared.tolist() == want


def test_the_shard_step_builds_the_whole_array(monkeypatch):
    called = []
    plain = html_text.suffix_array
    monkeypatch.setattr(html_text, "suffix_array", lambda t: called.append(len(t)) or plain(t))
    run = np.arange(html_text.MIN_RUN * 3, dtype=np.uint64)
    rows = pd.DataFrame({"host": "h", "page": [1, 2], "tokens": [run.tobytes(), np.r_[run, run[:3]].astype(np.uint64).tobytes()]})
    found = html_text._repeated_in_shard(rows)
    assert called and (found["pages"] == 2).sum() == html_text.MIN_RUN * 2 + 1

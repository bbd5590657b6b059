import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabguard.llm import html_extract, token_counts, topk

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body>
<header class="site"><a href="/">Home</a> Site</header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="wrap"><div class="sidebar">Elsewhere {i}</div>
<main><article class="post post-{i}"><h1>Title &amp; {i}</h1><p>First <em>para</em>graph&nbsp;here,
on two lines.<p>Second<br>part &lt;b&gt; <a href=x>linked</a></p><div class="ad">Buy</div><ul><li>item a<li>item b</ul>
<form><label>Mail</label><input></form><script>var x = "<p>no</p>";</script><!-- <p>no</p> --><aside>Related</aside></article>
<section class="comments"><article class="comment">Great post, really great post, says a reader at length {i}</article></section></main></div>
<footer>&copy; Site</footer>"""
WANT = "Title & {i}\n\nFirst paragraph here, on two lines.\n\nSecond part <b> linked\n\nitem a\n\nitem b"


def test_article_of_each_page(spark):
    rows = [(i, f"https://www.Host{i % 2}.example:80/x?{i}", PAGE.format(i=i)) for i in range(8)]
    rows += [(20, None, PAGE.format(i=20)), (21, "no url", None), (22, "http://h/", ""), (23, "http://h/", "plain  text")]
    rows += [(24, "http://h2/", "<article><p>unclosed <b>bold<p>next <!-- open"), (25, "http://h2/", "<<p a='>x < y & z &amp;lt; <")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS host")
    got = {r["page_id"]: r for r in html_extract.main_text(df).collect()}
    for i in (*range(8), 20):
        assert got[i]["text"] == WANT.format(i=i)
    assert [got[i]["text"] for i in (21, 22, 23, 24)] == ["", "", "plain text", "unclosed bold\n\nnext"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.main_text(df.filter("false")).count() == 0


def test_salted_join_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, "http://h/", PAGE.format(i=i)) for i in range(5)], "page_id long, url string, html string")
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    assert {r["text"] for r in html_extract.main_text(df).collect()} == {WANT.format(i=i) for i in range(5)}


def test_host_votes_decide(spark):
    usual = "<body><div class='main'><p>" + "long article text " * 20 + "</p></div><div class='x'><p>side</p></div></body>"
    odd = "<body><div class='main'><p>short</p></div><div class='x'><p>" + "a long side text that is no article " * 9 + "</p></div></body>"
    df = spark.createDataFrame([(i, "http://h/", usual) for i in range(5)] + [(9, "http://h/", odd)], "page_id long, url string, html string")
    assert html_extract.winners(df).collect()[0]["path"] == "/body/div.main"
    assert {r["page_id"]: r["text"] for r in html_extract.main_text(df).collect()}[9] == "short"


MARKS = ["<b>%s</b>", "<em class='x'>%s</em>", "%s", "%s", "<a href='/y'>%s</a>", "<span>%s</span>", "%s<!-- <p>no</p> -->"]
SIGNS = {"&amp;": "&", "&lt;b&gt;": "<b>", "&eacute;t&eacute;": "été", "&#8364;": "€", "x&nbsp;y": "x y", "wort": "wort"}


def random_page(r, kind, n):
    """A page of a host's kind and the blocks of its article."""
    words = lambda a, b: [r.choice(["alpha", "beta", "gamma", "delta", "omega", *SIGNS]) for _ in range(r.randint(a, b))]
    shown = lambda ws: " ".join(SIGNS.get(w, w) for w in ws)
    blocks, html = [], []
    for i in range(r.randint(3, 9)):
        ws = words(8, 40)
        marked = " \n ".join(r.choice(MARKS) % w if r.random() < 0.2 else w for w in ws)
        tag = "h1" if not i else r.choice(["p", "p", "p", "p class='skip-lines'", "h2", "blockquote", "pre", "figure", "li", "td"])
        close = f"</{tag.split()[0]}>" if r.random() < 0.8 or tag not in ("p",) else ""
        body = f"<{tag}>{marked}{close}"
        html.append({"li": f"<ul>{body}</ul>", "td": f"<table><tr>{body}</tr></table>"}.get(tag, body))
        blocks.append(shown(ws))
        if r.random() < 0.3:
            html.append(r.choice(["<div class='ad ad-%d'>Buy this now</div>", "<script>if (a < b) c('<p>%d</p>')</script>", "<aside>See also %d</aside>", "<form><input name=%d><label>Mail</label></form>", "<div class='share-buttons'>Share %d</div>", "<style>p{%d}</style>"]) % i)
    opening, closing = [
        ("<article>", "</article>"),
        ("<main id='main'><div class='post-%d'>" % n, "</div></main>"),
        ("<div class='article menu-open'>", "</div>"),
        ("<div class='col w-8 grid layout-sidebar has-sidebar'><div id='content'>", "</div></div>"),
        ("<section class='story a b c%d'>" % n, "</section>"),
        ("<div class='page-header-layout'><div class='entry-body'>", "</div></div>"),
        ("<div class='post post-comments-closed with-comments'>", "</div>"),
    ][kind]
    long = shown(words(60, 150))
    before = [f"<header><h2>Site {n}</h2></header>", "<nav><ul><li><a href=/>One</a><li><a href=/>Two</a></ul></nav>", "<div class='cookie-notice'>We use cookies</div>", "<div id=sidebar>Elsewhere today</div>", "<a class='skip-link' href='#c'>Skip</a>"]
    after = [f"<section class='comments'><h3>Comments</h3><div class='comment'><p>{long}</p></div></section>", "<div class='related-posts'><p>Related</p></div>", "<footer>All rights</footer>", "<div role='complementary'>More</div>", "<div class='newsletter-signup'>Sign up</div>"]
    r.shuffle(before)
    r.shuffle(after)
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{''.join(before[:r.randint(1, 5)])}{opening}{''.join(html)}{closing}{''.join(after[:r.randint(0, 5)])}</body></html>"
    return page, "\n\n".join(blocks)


def test_random_pages_by_their_making(spark):
    """Seven kinds of pages; what a page was made from is what comes out, whole."""
    r, rows, want = random.Random(12), [], {}
    for i in range(210):
        kind = i % 7
        page, want[i] = random_page(r, kind, i)
        rows.append((i, None if i % 30 == 29 else f"https://host{kind}.example/{i}", page))
    rows += [(1000 + i, "https://host0.example/", rows[0][2]) for i in range(50)]  # a repeated page
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(df).collect()}
    found = [got[i] == x for i, x in want.items()]
    assert all(found), [(rows[i][2], x, got[i]) for i, x in want.items() if got[i] != x][:1]
    assert {got[i] for i in range(1000, 1050)} == {want[0]}


def test_long_pages_and_clashing_names(spark):
    paragraphs = [f"paragraph {i} of a very long page &amp; more" for i in range(30000)]
    page = "<article>" + "".join(f"<p>{x}" for x in paragraphs) + "</article>"
    df = spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")
    df = df.selectExpr("*", "1 AS __path", "2 AS __host", "3 AS path", "4 AS `a.b`", "5 AS __salt", "'n' AS N_CHARS")
    out = html_extract.main_text(df)
    assert out.columns == [*df.columns[:-1], "text", "n_chars"]
    (got,) = out.collect()
    assert got["text"] == "\n\n".join(x.replace("&amp;", "&") for x in paragraphs) and (got["__path"], got["__host"], got["a.b"]) == (1, 2, 4)


def test_what_is_shown_and_what_a_name_says():
    text = lambda page: html_extract.extract(page, None)
    assert text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be</p><xmp>a <b> c</xmp></article>") == "Let x=2 be\n\na <b> c"
    assert text("<div class='comments'><p>" + "only readers " * 50 + "</p></div><div class='post'><p>Short.</p></div>") == "Short."
    assert text("<div class='one two three four-a'><p>a</p></div>") == "a"
    assert html_extract.votes("<div class='a1 b c d2'><p>text</p></div>") == {"/div.a0.b.c.d0": 1000, "": 1000}


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_counts_by_brute_force(spark, counter):
    texts = [None, "", "\n", "one line", "two\nlines\n", "\n\n a\n\n\nb é日本 ü😀\n", "x" * 500 + "\n" + "word " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rule in ("first", "last"):
        out = token_counts.token_counts(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, rule=rule)
        for r in out.collect():
            text = texts[r["doc_id"]] or ""
            ids = counter.coder.encode_ordinary(text)
            lines = text.splitlines(keepends=True) if text else []
            line_of = [n for n, x in enumerate(lines) for _ in x]
            character_of = [i for i, c in enumerate(text) for _ in c.encode()]
            want, crossing, at = [0] * len(lines), 0, 0
            for i in ids:
                size = len(counter.coder.decode_single_token_bytes(i))
                a, b = line_of[character_of[at]], line_of[character_of[at + size - 1]]
                want[a if rule == "first" else b] += 1
                crossing += a != b
                at += size
            assert (r["n_tokens"], r["n_sections"], r["section_tokens"], r["n_crossing"]) == (len(ids), len(lines), want, crossing)
    assert token_counts.token_counts(df.filter("false"), "x", "y").count() == 0


def test_given_sections(spark):
    df = spark.createDataFrame([(1, "ab cd ef gh", [0, 6, 100])], "doc_id long, text string, at array<int>")
    out = token_counts.token_counts(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "at").first()
    assert sum(out["section_tokens"]) == out["n_tokens"] and out["section_tokens"][2] == 0


def test_pieces_are_encoded_as_the_whole(counter, monkeypatch):
    text = "Some words here, and 12 more! " * 400
    whole = counter.encode(text)
    monkeypatch.setattr(token_counts, "PIECE", 1000)
    assert (counter.encode(text) == whole).all()


def exact(rows, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % 100:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 1024), (40, 2)])
def test_top_k_as_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(450)]
    rows += [(1000 + i, list(rows[i % 7][1])) for i in range(30)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8), (2100, []), (2200, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS rank")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == exact(rows, 10)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (100, [3e8])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100), (0, 2, 1), (100, 1, 1), (100, 2, 0)]
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_repeated_queries_ask_once(spark):
    rows = [(100, [2.0, 1.0]), (100, [1.0, 3.0]), *[(i, [float(i), 1.0]) for i in range(1, 13)], (7, [50.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    # the least vector asks; a repeated candidate stands for itself
    assert [x[1] for x in got] == [7, 12, 11, 10, 9, 8, 7, 6, 5, 4]
    assert [x[2] for x in got] == [(x + 3) << 20 for x in (47 + 0, 12, 11, 10, 9, 8, 7, 6, 5, 4)]


def test_bounds_hold_and_eliminate():
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e3, 1e8):
        x = np.floor(scale * rng.normal(size=(400, 64)) * np.exp(rng.normal(size=(400, 1))))
        x[5], x[6], x[7] = 0, x[8], 1e6 * x[9]
        table = topk.Table(x[:48])
        norm = (x * x).sum(1)
        bound = topk._bounds(table, table.distances(x), norm, table.distances(x), norm)(slice(0, 400))
        assert (bound >= x @ x.T).all()
    unit = rng.normal(size=(3000, 64))
    unit = np.floor(1024 * unit / np.sqrt((unit * unit).sum(1))[:, None])
    table, norm = topk.Table(unit[:48]), (unit * unit).sum(1)
    far = table.distances(unit)
    bound = topk._bounds(table, far[:50], norm[:50], far, norm)(slice(0, 50))
    tenth = np.sort(unit[:50] @ unit.T, 1)[:, -11]
    assert (bound >= tenth[:, None]).mean() < 0.5


def test_share_evaluated(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert 0 < topk.share_evaluated(df, F.col("vec_id") % 100 == 0) < 0.5


def test_a_hot_identifier_fills_no_block(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    rows = [(1, [1.0, 0.5])] * 400 + [(100, [1.0, 1.0]), (200, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(100, 1, 1), *[(100, n, 1) for n in range(2, 11)]] + [(200, 1, 100), *[(200, n, 1) for n in range(2, 11)]]


def test_section_starts(spark):
    assert token_counts.section_starts(None) == token_counts.section_starts([]) == token_counts.section_starts([None, -3]) == [0]
    assert token_counts.section_starts([6, None, 2, 6, -1]) == [2, 6]
    rows = [(1, "ab cd ef gh", [6, None, 3, 3]), (2, "ab cd", None), (3, "", [0, 2]), (4, "one two " * 20000, [80000, 0])]
    df = spark.createDataFrame(rows, "doc_id long, text string, at array<int>").selectExpr("*", "1 AS n_crossing", "'z' AS `x.y`")
    out = {r["doc_id"]: r for r in token_counts.token_counts(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "at").collect()}
    assert out[1]["n_sections"] == 2 and 0 < sum(out[1]["section_tokens"]) < out[1]["n_tokens"]
    assert out[2]["section_tokens"] == [out[2]["n_tokens"]] and out[3]["n_sections"] == 0 and out[4]["x.y"] == "z"
    assert sum(out[4]["section_tokens"]) == out[4]["n_tokens"] and abs(out[4]["section_tokens"][0] - out[4]["section_tokens"][1]) <= 2

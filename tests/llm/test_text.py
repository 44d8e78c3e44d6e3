"""Chat formatting, byte-level BPE, HTML extraction, decontamination."""

import hashlib
import html as entities
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.llm import byte_bpe, chat_format, decontaminate, html_text
from loomgraph.llm.registry import QUERIES


def test_chats_read_back_as_they_were(spark):
    random.seed(3)
    bits = ["<|", "<\\|", "<\\\\|im_end|>\n", "</s>", "[INST]", "[/INST]", "[\\INST]", "<s>", "\\", "\n", "x", "é🙂", "<|turn|>", "<", "|", "", "<|im_start|>user\n"]
    rows = [(i // 5, i % 5, random.choice(["user", "assistant", "system", "a\\n\nb", "<|x"]), "".join(random.choices(bits, k=random.randrange(6)))) for i in range(300)]
    rows += [(None, 1, None, None), (None, None, "assistant", "n"), (900, 1, "user", "b"), (900, 1, "user", "a"), (900, 1, "user", "a"), (901, 0, "assistant", "y" * 60_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat_format.format_chats(df)
    got = {r["conv_id"]: r for r in out.withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.masked(F.col("formatted"), F.col("loss_spans"))).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_messages"] == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:], strict=False))
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chats_of_very_many_turns(spark):
    """Thousands of turns in one conversation: nothing is copied for each turn."""
    rows = [(1, i, "assistant" if i % 3 else "user", f"<|{i}") for i in range(30_000)]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = out.withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()[0]
    assert r["n_messages"] == 20_000 and [t["text"] for t in r["turns"]] == [x[3] for x in rows]
    at = [(s["start"], s["length"]) for s in r["loss_spans"]]
    assert [r["formatted"][a : a + n].replace("\\", "", 1) for a, n in at] == [x[3] for x in rows if x[2] == "assistant"]


@pytest.fixture(scope="module")
def bpe():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = byte_bpe.Bpe(path, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_equals_the_library(bpe):
    own, library = bpe
    random.seed(5)
    kinds = ["ab \n", "  \t\nabcé", "the of and, .'s 12 ", "   a\x1cb\x85", "漢字かな🙂é ", "'s'll 've don't", "a", "\u2003 x", "<|endoftext|>"]
    texts = ["".join(random.choices(random.choice(kinds), k=random.choice([0, 1, 3, 10, 60, 400]))) for _ in range(500)]
    texts += [None, "", "a" * 5000, "ab" * 3000, "é" * 2500, " " * 50, "x" + " " * 9 + "y", "word\u1680next"]
    ids, at = own.encode(texts)
    flat, ends = own.decode(ids, at)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t or "")
        assert flat[ends[i] : ends[i + 1]].tobytes() == (t or "").encode()


def test_bpe_forgets_and_goes_on(bpe, monkeypatch):
    own, library = bpe
    monkeypatch.setattr(byte_bpe, "CACHED", 3)
    for k in range(4):
        ids, at = own.encode([f"alpha{k} beta{k} gamma delta{k}"] * 2)
        assert ids[at[1] :].tolist() == library.encode_ordinary(f"alpha{k} beta{k} gamma delta{k}")


def test_bpe_frames(spark, bpe):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.createDataFrame([(1, "a b", 4), (1, "a b", 4), (None, None, 5), (2, "", 6)], "doc_id long, text string, ids int")
    coded = byte_bpe.encode(df, path, pattern, keep_text=True)
    rows = byte_bpe.decode(coded, path, pattern).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in rows) == [(0, b""), (1, b"a b"), (1, b"a b"), (2, b"")]
    assert byte_bpe.encode(df.limit(0), path, pattern).count() == 0


def test_bpe_query(spark, sf, bpe):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op7_byte_bpe"](spark, sf).collect():
        ids = bpe[1].encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav><!-- <p>no</p> --><div class="cookie-notice">Cookies</div>
<main><article><header><h1>Head {n}</h1></header><p>One &amp; two<br>three {n} &copy;<p>Four <b>bo</b>ld &lt;x&gt;
<div class="share"><a href="#">Share</a></div><div>Sign up {site} now</div><ul><li>li {n}</li></ul><form><p>Mail</p></form><pre>a  b</pre></article>
<section id="comments"><article class="comment"><p>First!</p></article></section></main><aside>Side</aside><footer>&copy; {site}</footer></body></html>"""


def test_bpe_columns_with_dots(spark, bpe):
    docs = spark.createDataFrame([(1, "a word", "x", 2)], "doc_id long, `the.text` string, `a.b` string, `a c` int")
    import public_tokenizers as P

    rows = byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, text="the.text", decoded="decoded", keep_text=True)
    assert rows.columns == ["doc_id", "the.text", "a.b", "a c", "ids", "decoded"]
    assert [(r["a.b"], r["ids"], bytes(r["decoded"])) for r in rows.collect()] == [("x", bpe[1].encode_ordinary("a word"), b"a word")]


def test_html_text(spark):
    rows = [(i, f"http://s.org/{i}", PAGE.format(n=i, site="s")) for i in range(6)] + [(100, "http://t.org/", PAGE.format(n=7, site="t")), (101, None, None), (None, "x", ""), (102, "http://u/", "plain &eacute; text"), (103, "http://u/", "<p>a<p>b" + "<div>" * 3000 + "deep"), (104, "http://u/", "<p>" + "w " * 30_000)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    article = "Head {n}\nOne & two three {n} ©\nFour bold <x>\n{more}li {n}\na b"
    assert got[3] == article.format(n=3, more="")  # a container that all pages of the host share is template
    assert got[100] == article.format(n=7, more="Sign up t now\n")
    assert (got[101], got[None], got[102], got[103]) == ("", "", "plain é text", "a\nb\ndeep") and len(got[104]) == 59_999
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(none).count() == 0


def test_html_copies_make_no_template(spark):
    page = "<body><article><div>the same text</div></article></body>"
    rows = [(i, "http://s.org/", page) for i in range(30)]
    assert {r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"the same text"}


@pytest.mark.parametrize("most", [None, 0])
def test_html_template_of_a_large_host(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(html_text, "MOST_MARKS", most)
    box = lambda i: "<div>Season's sale</div>" if i % 10 == 0 else ""
    plain = lambda i, host: (i, f"http://{host}/{i}", f"<body>{box(i)}<div>text of {i}</div></body>")
    rows = [plain(i, "large.org") for i in range(50)] + [plain(100, "small.org"), plain(100, "small.org"), (None, "http://large.org/a", "<article><p>own</p><div>Season's sale</div><p>Season's sale</p></article>"), (200, None, None)]
    got = sorted((str(r["page_id"]), r["text"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = [(str(i), f"text of {i}") for i in range(50)] + [("100", "Season's sale\ntext of 100")] * 2 + [("None", "own\nSeason's sale"), ("200", "")]
    assert got == sorted(want)


def article_of(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h\d)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_html_query(spark, sf):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op9_html_text"](spark, sf).collect():
        assert r["text"] == article_of(source[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_html_recurrence_decides_without_names(spark, sf):
    """Menus, adverts and footers of real pages go because they recur, with all names left aside; an empty template keeps them."""
    pages = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/pages.parquet")
    host = html_text.host_and_path(F.col("url"))[0]
    source = {r["page_id"]: article_of(r["html"]) for r in pages.collect()}
    right = lambda **k: {r["page_id"] for r in html_text.extract(pages, cues=False, **k).collect() if r["text"] == source[r["page_id"]]}
    found = right()
    assert len(found) > 0.15 * len(source) and not right(min_pages=10**9)
    # a menu that recurs is gone wherever it stands, in the order of the method: four different pages make it a template
    menu = F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1)
    often = {r["page_id"] for r in pages.withColumn("n", F.approx_count_distinct("html").over(Window.partitionBy(host, menu))).where("n >= 6").collect()}
    assert often and often <= found


def test_html_names_on_one_page():
    text = lambda x: html_text.main_text(x, set())
    assert text('<article><p>a <button>Share</button> b <span class="advert">Buy <span>now</span></span> c</p><label>Name</label></article>') == "a b c"
    assert text('<body><div data-id="footer" title="x class=ad">real text</div><div id=nav-2>no</div><div CLASS=\'ad\'>no</div></body>') == "real text"
    assert text('<article><h1 class="header">One</h1><div class="entry-header"><h2>Two</h2></div><p>x</p></article><div>side</div>') == "One\nTwo\nx"
    assert text("<body><header><h1>Site</h1></header><h1>Head</h1><p>one<p>two<footer>f</footer></body>") == "Head\none\ntwo"
    # an article element that holds next to nothing isn't the article
    assert text("<body><article>!</article><p>" + "the article " * 9 + "</p></body>") == "!\n" + " ".join(["the article"] * 9)
    assert text('<p>keep <span class="q">k<span>m</span>n</span> on</p>') == "keep kmn on"


def test_html_names_never_delete_the_article():
    text = lambda x: html_text.main_text(x, set())
    article = "<article><h1>Head</h1><p>the text of it</p></article>"
    for names in ('class="site has-sidebar"', 'id="content" class="no-sidebar"', 'class="site header-fixed"', 'class="overlay"', 'class="menu page"'):
        assert text(f"<body><div {names}>{article}</div></body>") == "Head\nthe text of it", names
    assert text(f'<body><div class="widget-area-right"><main><p>one</p></main></div></body>') == "one"  # noqa: F541
    assert text(f"<body><form><nav>menu</nav>{article}</form></body>") == "Head\nthe text of it"
    # without such elements what holds most of the text stays, unless it says comments or is mostly links
    assert text('<body><div class="search"><p>' + "much text of the page " * 5 + '</p></div><div class="menu">x</div></body>') == ("much text of the page " * 5).strip()
    assert text('<body><p>short</p><div class="comments"><p>' + "a long comment " * 9 + '</p></div><div class="related"><a href=x>' + "a link " * 40 + "</a></div></body>") == "short"
    # an article under such a name is no article where there is another, or more text
    assert text(f'<body>{article}<div class="related"><article><p>other</p></article></div></body>') == "Head\nthe text of it"
    assert text('<body><aside><article>card</article></aside><div><p>' + "the page itself " * 4 + "</p></div></body>") == ("the page itself " * 4).strip()


def test_html_names_inside_the_article():
    text = lambda x: html_text.main_text(x, set())
    inner = '<section id="related-work"><p>a</p></section><section class="social-history"><p>b</p></section><h2 id="copyright">c</h2><ul class="menu"><li>soup</li><li>bread</li></ul><p>See <a class="share-link" href=x>the shared ledger</a> for it.</p>'
    assert text(f"<article>{inner}</article>") == "a\nb\nc\nsoup\nbread\nSee the shared ledger for it."
    gone = '<ul class="share"><li><a href=x>Share</a><li><a href=y>Post</a></ul><div class="ad-slot-3">Buy</div><p class="ad">Buy</p><div class="post-comments"><p>First!</p></div><div class="notice">We moved</div><div class=newsletter>Mail</div>'
    assert text(f"<article><p>x</p>{gone}</article>") == "x"
    # however short the article, and however long what stands beside it
    for beside in ("<div>" + "an unmarked box " * 20 + "</div>", '<section class="discussion">' + "<p>said so</p>" * 30 + "</section>"):
        assert text(f"<body><article><p>a short article</p></article>{beside}</body>") == "a short article"


def test_html_rare_shared_sections(spark):
    """What stands in four of a large host's articles is no template; what stands in a part of all pages is."""
    page = lambda i: f"<body>{'<div>the season sale</div>' if i % 10 == 0 else ''}<article><p>own {i}</p>{'<section><p>an appendix</p></section>' if i < 4 else ''}</article></body>"
    rows = [(i, "http://s.org/", page(i)) for i in range(300)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own {i}" + ("\nan appendix" if i < 4 else "") for i in range(300)}


def test_html_passages_that_articles_share(spark):
    shared = lambda i: "<p>a passage of many articles</p>" if i % 3 == 0 else ""
    notice = '<p>We moved to a new address.</p><span class="x7">Buy now!</span>'
    page = lambda i: f"<body><div class=q{i}>menu {i % 2}</div><article><p>own {i}</p>{shared(i)}{notice}</article></body>"
    rows = [(i, "http://s.org/", page(i)) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own {i}" + ("\na passage of many articles" if i % 3 == 0 else "") for i in range(30)}


def test_html_place_of_menus(spark):
    """A menu that no other page has goes too, if most of those in its place recur; copies of a whole page stay."""
    page = lambda i: f"<body><ul class=z9><li>entry {i if i % 5 == 0 else 0}</li></ul><div>text of {i}</div></body>"
    rows = [(i, "http://s.org/", page(i)) for i in range(40)] + [(100 + i, "http://c.org/", f"<body><div>all the same</div><i>{i}</i></body>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text of {i}" for i in range(40)} | {100 + i: str(i) for i in range(6)}
    whole = [(i, "http://d.org/", f"<body><div>all the same</div><img src={i}></body>" + f"<!-- {i} -->") for i in range(6)]
    got = {r["text"] for r in html_text.extract(spark.createDataFrame(whole, "page_id long, url string, html string")).collect()}
    assert got == {"all the same"}


def test_html_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>", "old", 5, 6, "d.t")], "page_id long, url string, html string, `Text` string, host int, key int, `a.b` string")
    rows = html_text.extract(df)
    assert rows.columns == ["page_id", "url", "host", "key", "a.b", "text"] and [tuple(r) for r in rows.collect()] == [(1, "http://a.b/", 5, 6, "d.t", "x")]


def brute_contamination(docs, items, width):
    wins = {}
    for i, t in items:
        w = decontaminate.words_of(t)
        if i is not None and w:
            for k in range(max(1, len(w) - width + 1)):
                wins.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = decontaminate.words_of(t)
        hit, found = set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_against_brute_force(spark, seed):
    random.seed(seed)
    say = lambda n: " ".join(random.choices("a b c D é1 x-y".split(), k=n))
    docs = [(i, say(random.choice([0, 1, 5, 40]))) for i in range(60)] + [(1, "a b c"), (1, "a b c"), (None, "a b c d"), (7, None), (8, ""), (9, "a " * 20_000)]
    items = [(i, say(random.choice([1, 2, 4, 6]))) for i in range(12)] + [(3, "c d a b"), (None, "x"), (99, None), (98, ""), (97, "...")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"), width=4).drop("text_hash")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_contamination(docs, items, 4)


def test_decontamination_blocks_slack_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two other three four"), (2, "one two three four"), (3, "four three two one")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "one two three four"), (6, "two three four")], "item_id long, text string")
    hits = lambda **k: {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, items, **k).collect()}
    assert hits() == {1: (0, 0), 2: (4, 2), 3: (0, 0)}
    assert hits(slack=1)[1][1] == 2 and hits(slack=1)[3] == (0, 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 15)
    assert hits() == {1: (0, 0), 2: (4, 2), 3: (0, 0)}
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert {r["contaminated"] for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {False}


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 0, 2), (1, 2, 0), (2, 0, 1)])
def test_decontamination_with_items_without_words(spark, order):
    docs = [(1, "one two three four"), (2, "five six"), (3, "seven")]
    items = [[(5, "two three")], [(6, "... !!!")], [(7, "five six")]]
    rows = [x for i in order for x in items[i]]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string"), width=4).drop("text_hash")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_contamination(docs, rows, 4)


def test_decontamination_of_repetitive_texts(spark):
    """An item of one word in a text of that word: lists are intersected by sets, so time grows with their size."""
    docs = [(1, "a " * 100_000 + "b"), (2, "a " * 9), (3, "b a " * 20_000)]
    items = [(1, "a " * 10), (2, "b " + "a " * 9), (3, "a " * 40 + "b")]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (100_001, 100_001, 2), 2: (9, 0, 0), 3: (40_000, 0, 0)}


def test_decontamination_with_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("x", "one two three"), (None, "one two three"), ("y|1", "none")], "name string, body string")
    got = decontaminate.contamination(docs, spark.createDataFrame([(1, "two three")], "item_id long, text string"), id="name", text="body")
    assert {(r["doc_id"], r["n_hit"]) for r in got.collect()} == {("x", 2), (None, 2), ("y|1", 0)}


def test_memory_of_an_encoding_worker():
    """Loading the tables and encoding 6 MB of text take a worker less than 80 MB, whatever is in a batch."""
    import tracemalloc

    import pyarrow as pa

    words = [("".join(random.Random(i).choices("abcdefghij", k=6))) for i in range(5000)]
    texts = [" ".join(random.Random(i).choices(words, k=150)) for i in range(6000)]
    batch = pa.record_batch({"text": texts})
    tracemalloc.start()
    bpe, held = byte_bpe.Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), 0
    for step in byte_bpe._steps(iter([batch]), byte_bpe._sizes("text"), byte_bpe.CODE_BYTES):
        flat, offsets = bpe.encode(step.column("text").to_pylist())
        held += len(bpe.decode(flat, offsets)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held == sum(map(len, texts))
    assert peak < 80e6, peak

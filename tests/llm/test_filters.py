"""URL filter, language identification, toxicity."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import common, language_id, toxicity, url_filter
from loomgraph.llm.registry import ORACLES, QUERIES


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(site), site, action) for site, action in url_filter.SITE_RULES for h, p in [site.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fits:
        _, site, action = max(fits)
        return host, path, site, action
    tokens = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (host + path).translate({i: i + 32 for i in range(65, 91)}))
    return host, path, None, "block" if set(tokens) & set(url_filter.UNWANTED) else "allow"


def rules():
    return (*(url_filter.site_rule(s, a) for s, a in url_filter.SITE_RULES), *url_filter.DEFAULT_RULES)


def test_url_filter_against_brute_force(spark):
    random.seed(4)
    hosts = ["example.com", "www.example.com", "notexample.com", "EXAMPLE.com", "a.net", "net", "x.org", "casino-win.org", "my.casino.io", "casinos.io", "exämple.net", "", "com:80", "user@net", "a.com.org"]
    paths = ["", "/", "/en/", "/en", "/en/x", "/es/1", "/fr/", "/fr", "/xxx/", "/axxx", "/xxx", "//en/", "/en/?a=/es/", "#/en/", "?/fr/", "/\n/poker"]
    urls = [f"{random.choice(['http', 'https', 'x://y'])}://{h}{p}" for h in hosts for p in paths] + ["", None, "no scheme", "://", "://net/fr/", "http://a.net/es/" + "b" * 50_000]
    rows = [(i % 50, u, "x") for i, u in enumerate(urls * 2)] + [(None, "http://a.net/es/", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, target string").withColumn("verdict", F.lit(9))
    got = sorted(((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules()).collect()), key=repr)
    assert got == sorted(((i, u, *brute_url(u)) for i, u, _ in rows), key=repr)


def test_url_rules_without_tokens_and_wildcards(spark):
    own = [url_filter.Rule("*.gif", "block"), url_filter.Rule("||ads.*^banner^", "block", tier=2), url_filter.Rule("^ok^", "allow", tier=3)]
    table = url_filter.rule_table(spark, own)
    assert [r[0] for r in table.select(url_filter.literal_tokens(F.col("pattern"))).collect()] == [[], ["ads", "banner"], ["ok"]]
    df = spark.createDataFrame([("http://a/x.gif",), ("http://ads.b/c/banner/",), ("http://ads.b/ok/banner",), ("http://bads.b/banner",)], "url string")
    assert {r["url"]: r["verdict"] for r in url_filter.judge(df, own).collect()} == {"http://a/x.gif": "block", "http://ads.b/c/banner/": "block", "http://ads.b/ok/banner": "allow", "http://bads.b/banner": "allow"}
    assert url_filter.judge(df.limit(0), own).count() == 0


def fits(pattern, fold, target):
    """Plain matching, position by position, without regular expressions."""
    if fold:
        low = {i: i + 32 for i in range(65, 91)}
        pattern, target = pattern.translate(low), target.translate(low)
    body = pattern.removeprefix("||")
    edge = lambda c: not (c.isalnum() or ord(c) > 127)

    def at(i, k):
        if k == len(body):
            return True
        if body[k] == "*":
            return any(at(j, k + 1) for j in range(i, len(target) + 1))
        if body[k] == "^":
            return i in (0, len(target)) and at(i, k + 1) or i < len(target) and edge(target[i]) and at(i + 1, k + 1)
        return i < len(target) and target[i] == body[k] and at(i + 1, k + 1)

    host = target.split("/")[0]
    starts = [0, *(i + 1 for i, c in enumerate(host) if c == ".")] if pattern.startswith("||") else range(len(target) + 1)
    return any(at(i, 0) for i in starts)


@pytest.mark.parametrize("shuffled", [False, True])
def test_thousands_of_rules(spark, monkeypatch, shuffled):
    """A rule list of real size, as a table, against plain matching of every rule with every URL."""
    if shuffled:
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(common, "FEW", 0)
        monkeypatch.setattr(common, "HOT", 3)
    random.seed(9)
    words = [f"{a}{b}" for a in "ad be ca du el fi go hu".split() for b in "min ner tor pix".split()]
    word = lambda: random.choice(words) + random.choice(["", "", str(random.randrange(30))])
    kinds = [lambda: f"||{word()}.{word()}^", lambda: f"/{word()}/{word()}/", lambda: f"^{word()}=*&{word()}", lambda: f"{word()}.js", lambda: f"||{word()}.com/{word()}*.(x)", lambda: f"*{random.choice('+$')}{word()}?", lambda: "." + word().upper() + "^"]
    rules = [(random.choice(kinds)(), random.choice(["allow", "block"]), f"r{i}", random.randrange(3), random.random() < 0.8) for i in range(3000)] + [(None, "block", "x", 9, True), ("^gomin^", None, "x", 9, True)]
    urls = [f"http://{word()}.{random.choice([word(), 'COM', 'com'])}/{random.choice([word(), word().upper()])}{random.choice(['/', '.js', '=1&', '-', '.(x)'])}{word()}/" for _ in range(120)] + [None, "x", "http:///"]
    urls += urls[:1] * 5
    df = spark.createDataFrame([(i, u, 1, 2, 3) for i, u in enumerate(urls)], "page_id long, url string, target int, best int, `Host` int")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, spark.createDataFrame(rules, "pattern string, action string, name string, tier int, fold boolean")).collect()}
    assert len(got) == len(urls)
    hits = 0
    for i, u in enumerate(urls):
        host, path = brute_url(u)[:2]
        best = max(((t, len(p), a == "allow", p, n, a) for p, a, n, t, f in rules if p and a and host + path and fits(p, f, host + path)), default=None)
        hits += best is not None
        assert got[i] == ((best[4], best[5]) if best else (None, "allow")), u
    assert hits > 20
    kept = url_filter.judge(df, []).columns
    assert kept == ["page_id", "url", "target", "best", "host", "path", "rule", "verdict"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def greedy(text, corpus):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in corpus:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_cross_parsing_counts_phrases():
    random.seed(1)
    langs = {"a": bytes(random.choice(b"abc ") for _ in range(300)), "b": bytes(random.choice(b"bcd ") for _ in range(300))}
    model = language_id.Model(langs)
    texts = [bytes(random.choice(b"abcd ") for _ in range(random.choice([1, 5, 60, 900]))) for _ in range(30)]
    got = model.phrases(texts)
    for t, row in zip(texts, got, strict=True):
        for name, n in zip(model.langs, row, strict=True):
            known = set(langs[name])
            if all(c in known for c in t):
                assert n == greedy(t, langs[name])
            else:  # a byte that a language doesn't have is a phrase together with the end of the one before
                assert 0 < n <= greedy(t, langs[name]) + 1


def test_long_texts_are_parsed_whole(monkeypatch):
    """Blocks carry the parse over: phrases are those of one greedy parse, however small the blocks are."""
    random.seed(8)
    corpora = {"a": bytes(random.choice(b"ab ") for _ in range(400)), "b": b"ab" * 300 + b" ", "c": bytes(random.choice(b"aab ") for _ in range(500))}
    model = language_id.Model(corpora)
    texts = [bytes(random.choice(b"ab ") for _ in range(n)) for n in (0, 1, 39, 40, 41, 700, 1300)] + [b"ab" * 900, b"a" * 500, b"ba" * 41]
    want = [[greedy(t, corpora[x]) if t else 1 for x in model.langs] for t in texts]
    for steps in (1, 3, 40, 1024):
        monkeypatch.setattr(language_id, "STEPS", steps)
        assert model.phrases(texts).tolist() == want


def test_learning_takes_whole_rows_and_survives_repeated_ids(spark):
    rows = [(1, f"the cat number {'x' * (i % 7)}", "en") for i in range(300)] + [(i, "der hund " * 4000, "de") for i in range(5)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(labelled, rows=3, size=2000)
    assert model.langs == ["de", "en"] and 2 ** model.bits.max() <= 2000
    df = spark.createDataFrame([(1, "the cat", "old", 2.0), (2, "der hund", "old", 2.0)], "doc_id long, text string, `Lang_Pred` string, `SCORE` double")
    out = language_id.predict(df, model)
    assert out.columns == ["doc_id", "lang_pred", "score"] and {r["doc_id"]: r["lang_pred"] for r in out.collect()} == {1: "en", 2: "de"}


def test_toxicity_of_repeated_ids_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, f"text {i}", 1, "x") for i in range(40)] + [(2, "good", 1, "x")], "doc_id long, text string, `Score` int, kept string")
    model = toxicity.learn(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    out = toxicity.score(docs, model, keep_text=True)
    assert out.columns == ["doc_id", "text", "kept", "score"] and {(r["kept"], 0 <= r["score"] <= 1) for r in out.collect()} == {("x", True)}


def test_language_query(spark, sf):
    rows = QUERIES["op3_language_id"](spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and held and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark):
    labelled = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (None, "el perro y el gato", "es"), (4, "le chat", None)], "doc_id long, text string, lang string")
    model = language_id.learn(labelled)
    assert model.langs == ["de", "en"]
    docs = spark.createDataFrame([(1, "the dog and the cat", 5), (1, "the dog and the cat", 5), (None, "die katze und der hund", 6), (2, None, 7), (3, "", 7), (4, "12 ²½ _!", 7), (5, "漢字", 7), (6, "the cat " * 20_000, 7)], "doc_id long, text string, lang_pred int")
    got = sorted(((r["doc_id"] or 0, r["lang_pred"], r["score"] > 0) for r in language_id.predict(docs, model).collect()))
    # letters that no language knows cost the least where the learned text is shortest
    assert [g[:2] for g in got] == [(0, "de"), (1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (6, "en")]
    none = language_id.learn(labelled.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_toxicity_finds_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in QUERIES["op4_toxicity"](spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in labels]
    assert len(got) == 1000 and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def trained(spark, penalty):
    random.seed(2)
    rows = []
    for i in range(400):
        toxic = i % 2
        words = random.choices("stone river tree cloud road lamp".split(), k=6)
        if toxic:
            words += ["vile"] if i % 4 == 1 else ["rotten"]
        if random.random() < (0.9 if toxic else 0.1):
            words.append("muslim")
        rows.append((i, " ".join(words), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), penalty).scorer()


def test_counterfactual_penalty_keeps_mentions_neutral(spark):
    fair, plain = trained(spark, toxicity.PENALTY), trained(spark, 0.0)
    odds = lambda p: np.log(p / (1 - p))
    change = lambda f: abs(odds(f("stone river muslim")) - odds(f("stone river christian")))
    assert change(fair) < 0.1 * change(plain)
    assert fair("a muslim at the river") < 0.5 < fair("a vile christian at the river") and plain("a vile tree") > 0.5


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, "bad words here", 3), (1, "bad words here", 3), (None, "good", 3), (2, None, 3), (3, "", 3), (4, "bad " * 50_000, 3)], "doc_id long, text string, score int")
    none = toxicity.learn(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] < 0.01 for r in toxicity.score(docs, none).collect()} == {True}
    one = toxicity.learn(docs.select("doc_id", "text"), spark.createDataFrame([(1, 1), (1, 0), (9, 1), (None, 1), (2, None)], "doc_id long, toxic int"))
    rows = toxicity.score(docs, one, keep_text=True).collect()
    assert len(rows) == 6 and all(0.5 < r["score"] <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), one).count() == 0


def test_every_term_of_a_list_is_swapped_in():
    for terms in toxicity.IDENTITY:
        for t in terms:
            got = {x.decode() for s in toxicity.swapped({t.encode(), b"word"}) for x in s} - {"word"}
            assert set(terms) - {t} <= got

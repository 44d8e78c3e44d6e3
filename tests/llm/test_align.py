import hashlib
from collections import Counter

import public_tokenizers as P
import pytest

from loomgraph.llm import common, token_align
from loomgraph.llm.registry import QUERIES

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_figures(rows, libraries):
    """Whole texts, token by token, with sets of ends."""
    a, b = libraries
    letters = {c: n for n, c in token_align.LETTER_OF.items()}
    names = {n: t for t, n in a.get_vocab(with_added_tokens=True).items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc, text in rows:
        x = y = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bx, by = [bytes(letters[c] for c in names[i]) for i in x], [piece(i) for i in y]
        whole = b" " + (text or "").encode()
        if not text or b"".join(bx) != whole or b"".join(by) != whole:
            docs.append((doc, 0, 0, [], ""))
            continue
        ends_x, ends_y = ([sum(map(len, side[: k + 1])) for k in range(len(side))] for side in (bx, by)) if len(whole) < 3000 else map(ends, (bx, by))
        shared = sorted(set(ends_x) & set(ends_y))
        at_x, at_y = {e: k for k, e in enumerate(ends_x)}, {e: k for k, e in enumerate(ends_y)}
        groups, i, j = [], 0, 0
        for e in shared:
            groups.append((x[i : at_x[e] + 1], y[j : at_y[e] + 1]))
            i, j = at_x[e] + 1, at_y[e] + 1
        links = [(x[at_x[e]], y[at_y[e]]) for e in shared]
        counts.update(links)
        docs.append((doc, len(x), len(y), links, ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted(
        ((d, n, m, len(k), len(k), sum(counts[x] == top[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, n, m, k, g in docs), key=repr
    )


def ends(side):
    out, at = [], 0
    for x in side:
        at += len(x)
        out.append(at)
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces   three "), (5, "a▁b plain words"), (5, "a▁b plain words"), (None, "the words"), (None, "the words"), (6, "<|endoftext|> and <s>hi</s> <unk> <0x41>"),
    (7, "nul\x00 tab\t x\x1c y\x85 z\xa0 w   v"), (8, "emoji 🙂🙂 ﬁ ① 漢字 can't  I'll 'tis"), (9, "\n\n lines \r\n and  \n more"), (10, "x" * 5000 + " " + "é" * 3000), (11, "words of a very long text, again. " * 9000),
    (12, "naïve, Ærø; café: ÿes! ß? ×÷"), (13, "12 3.14, 7-8 a1 b_c"), (14, " lead"), (15, "trail "), (16, "the the the"),
]


def test_align_odd_texts(spark, libraries):
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in ODD], "doc_id long, text string, row string, pairs int")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in token_align.align_documents(docs).collect()), key=repr)
    assert got == plain_figures(ODD, libraries)


def test_align_query_on_whole_documents(spark, sf, libraries):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, sf, "documents").collect()]
    out = QUERIES["op13_token_align"](spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), ("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("groups_sha256", "string"), ("n_links", "bigint"), ("n_best", "bigint"), ("count_sum", "bigint")]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=repr) == plain_figures(rows, libraries)


def test_align_with_a_full_cache_and_a_shuffled_join(spark, libraries, monkeypatch):
    monkeypatch.setattr(common, "FEW", 5)
    monkeypatch.setattr(common, "HOT", 20)
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in token_align.align_documents(docs).collect()), key=repr)
    assert got == plain_figures(ODD, libraries)
    monkeypatch.setattr(token_align, "CACHED", 3)
    aligner = token_align.Aligner(A, B)
    said = [x[3] for _ in range(2) for t in ODD for x in aligner.align([t[1]])]
    assert said[: len(ODD)] == said[len(ODD) :]
    whole = token_align.Aligner(A, B)
    whole.cuts = False
    assert said[: len(ODD)] == [x[3] for x in whole.align([t for _, t in ODD])]


def test_align_an_empty_table(spark):
    assert token_align.align_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_two_pointers():
    sizes = [1, 2, 3]
    assert token_align.groups([0, 1, 2], [2, 0, 1], sizes, sizes) == [([0, 1], [2]), ([2], [0, 1])]
    assert token_align.groups([], [], sizes, sizes) == []

from fractions import Fraction
from itertools import permutations

import pytest

from loomgraph.llm import filter_audit
from loomgraph.llm.registry import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, mask int, hash string, n_chars long"


def plain_audit(docs, labels):
    """Chains played out document by document."""
    def fails(i, t):
        words = [w for w in __import__("re").split("[ \t-\r]+", t) if w]
        older = [d for d, u in docs_ids if d is not None and i is not None and d < i and u == t]
        return {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": bool(older),
        }

    docs_ids = [(d, t or "") for d, t, _ in docs]
    rows = [(p or "", d, fails(d, t or "")) for d, t, p in docs]
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    out = {}
    for part in {p for p, _, _ in rows}:
        mine = [(d, f) for p, d, f in rows if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone, left_ = [x for x in left if x[1][c]], [x for x in left if not x[1][c]]
                total[c] += len(gone)
                n_fail = sum(f[c] for _, f in mine)
                alone = sum(f[c] and sum(f.values()) == 1 for _, f in mine)
                out[part, "".join(order), step] = [len(left_), len(gone), n_fail - len(gone), alone, sum(d is not None and d in good for d, _ in gone), sum(d is not None and d in toxic for d, _ in gone)]
                left = left_
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_audit_query_equals_its_sql(same):
    same(QUERIES["op11_filter_audit"], ORACLES["op11_filter_audit"])


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, long, "a"), (2, long, "b"), (2, long, "b"), (3, long, None), (None, long, "a"), (4, None, "a"), (5, "", "a"), (6, "", ""), (7, "X|\x85é  \x0b Y", "b"), (8, "a " * 300, "b"),
        (9, "ABC " + long, "a"), (9, "ABC " + long, "a"), (10, long + " #", None), (11, "word " * 40_000, "b"), (12, "\t\r\n\x0c", "c"),
    ]
    labels = [(1, 1, 0), (2, None, 1), (2, 1, None), (5, 0, 1), (None, 1, 1), (99, 1, 1), (11, 1, 1)]
    frame = spark.createDataFrame([(d, t, "x", s, 3, "h", 1) for d, t, s in docs], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(filter_audit.failure_masks(frame, marks)).collect()}
    assert got == plain_audit(docs, labels)


def test_audit_of_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit(filter_audit.failure_masks(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


@pytest.mark.parametrize("n", [1, 3, 4])
def test_removal_polynomial(n):
    counts = {m: (m * 7 + 3) % 11 for m in range(1 << n)}
    f = filter_audit.Removal(counts, n)
    removed = lambda s: sum(c for m, c in counts.items() if m & s)
    assert [f.removed(s) for s in range(1 << n)] == [removed(s) for s in range(1 << n)]
    orders = list(permutations(range(n)))
    for i in range(n):
        gain = sum(removed(sum(1 << j for j in o[: o.index(i) + 1])) - removed(sum(1 << j for j in o[: o.index(i)])) for o in orders)
        assert f.shapley(i) == Fraction(gain, len(orders))


def test_audit_of_three_filters(spark):
    masks = spark.createDataFrame([("p", 0b101, 4, 1, 0), ("p", 0b010, 2, 0, 2), ("p", 0, 5, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(masks, "XYZ").collect()}
    assert len(rows) == 18
    assert (rows["XYZ", 1]["removed"], rows["XYZ", 3]["removed"], rows["XYZ", 3]["redundant"], rows["XYZ", 3]["kept"], rows["ZXY", 1]["shapley"]) == (4, 0, 4, 5, 12)

"""Filter interactions against a plain loop over documents and orders."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np

from parleyspark.llm import filter_audit as A
from parleyspark.llm import queries

ROWS = [
    (1, None, None), (2, "", ""), (3, "word " * 150, "en"), (4, "SHOUT Now", "en"), (5, " ".join(f"w{i}" for i in range(200)), "en"),
    (6, " ".join(f"w{i}" for i in range(200)), "de"), (7, "a # b", "de"), (None, "a # b", "de"), (7, "a # b", "de"), (8, "a # b", None), (9, "Ab " * 50 + "$", "fr"),
]
LABELS = [(3, 1, 0), (3, 0, 1), (4, None, 1), (5, 1, None), (6, 1, 1), (6, 1, 1), (7, 1, 0), (None, 1, 1), (99, 1, 1)]


def brute(rows, labels):
    good, bad = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out, parts = {}, defaultdict(list)
    for i, text, lang in rows:
        t = text or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(found) < 100, "B": 100 * len(set(found)) < 80 * len(found), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in least and i > least[t],
        }
        parts[lang or ""].append((i, {f for f, x in fails.items() if x}))
    for part, docs in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                removed, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                failing = [d for d in docs if f in d[1]]
                shapley[f] += len(removed)
                out[part, "".join(order), step + 1] = [len(left), len(removed), len(failing) - len(removed), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in removed), sum(d[0] in bad for d in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def collected(df):
    return {tuple(r[:3]): list(r[3:]) for r in df.collect()}


def test_against_a_loop(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string").selectExpr("*", "'own' as part", "'own' as mask", "1 as digest")
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").selectExpr("*", "'own' as good")
    got = collected(A.audit(A.failures(docs), labels))
    want = brute(ROWS, LABELS)
    assert len(got) == len(want) == 4 * 600 and got == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    frame = queries.QUERIES["op13_filter_audit"](spark, sf)
    assert frame.columns == ["part", "filter_order", "step", *A.COUNTS]
    assert collected(frame) == brute(rows, labels)


def test_removal_steps():
    orders, steps = A.removal_steps(3)
    for mask in range(8):
        for k, order in enumerate(orders.tolist()):
            want = [p for p, f in enumerate(order) if mask >> f & 1]
            assert steps[mask, k] == (want[0] if want else A.NEVER)


def test_each_order_removes_the_same():
    rng = np.random.default_rng(0)
    orders, steps = A.removal_steps(5)
    counts = rng.integers(0, 50, (32, 3))
    found = A.scatter(counts, orders, steps)
    assert (found["removed"].sum(1) == counts[1:, 0].sum()).all() and (found["kept"][:, -1] == counts[0, 0]).all()
    assert (found["good_lost"].sum(1) == counts[1:, 1].sum()).all() and (found["redundant"] >= 0).all()


def test_empty_table_and_hot_copies(spark):
    docs = spark.createDataFrame([(i, "one text of all", "en") for i in range(3000)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = collected(A.audit(A.failures(docs), labels))
    assert got["en", "EABCD", 1][:3] == [1, 2999, 0] and got["en", "AEBCD", 2][:3] == [0, 0, 2999]
    assert A.audit(A.failures(docs.where("false")), labels).collect() == []


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "W " * 1_000_000, "en"), (2, "x" * 2_000_000, "en")], "doc_id bigint, text string, lang string")
    assert {r["doc_id"]: r["mask"] for r in A.failures(docs).collect()} == {1: 2 + 4, 2: 1}

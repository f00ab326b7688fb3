"""Order MinHash against plain Python over strings, and with_edits against a loop over sorted documents."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parleyspark.llm import order_minhash as M
from parleyspark.llm import queries

SF = "/root/testdata/sf0.001"
WORD = 1 << 64


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % WORD
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % WORD
    return x ^ (x >> 31)


def brute(text, s=M.Settings()):
    """Every k-mer under every order, by sorting all of them."""
    step, k = int(M.STEP), min(s.k, len(text))
    grams = [text[i : i + k] for i in range(len(text) - k + 1)] if text else []
    names, seen, numbered = {}, {}, []
    for place, gram in enumerate(grams):
        if gram not in names:
            h = k
            for c in gram:
                h = (h * step + ord(c)) % WORD
            names[gram] = mixed(h) >> M.PLACE_BITS << M.PLACE_BITS
        nth = seen[gram] = seen.get(gram, 0) + 1
        numbered.append((names[gram], place, mixed((names[gram] + nth * step) % WORD)))
    numbered.sort()
    out = []
    for factor in M._orders(s.size):
        least = sorted(range(len(numbered)), key=lambda i: (numbered[i][2] >> 32) * int(factor) % (1 << 32))[: s.chosen]
        h = 0
        for i in sorted(least, key=lambda i: numbered[i][1]):
            h = mixed((h * step + numbered[i][0]) % WORD)
        out.append(h % (1 << 32))
    return out if text else [0] * s.size


TEXTS = ["", "a", "abcdefg", "abcdefgh", "aaaaaaaaaaaaaaaaaaaaa", "héllo wörld 你好 🙂 and more of the same", "the cat sat on the mat. the cat sat on the mat. " * 3]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("s", [M.Settings(), M.Settings(3, 3, 16)])
def test_fingerprint(text, s):
    assert M.fingerprint(text, s).tolist() == brute(text, s)


def test_fingerprint_in_pieces(monkeypatch):
    text = " ".join(str(i * i) for i in range(400))
    whole = M.fingerprint(text).tolist()
    monkeypatch.setattr(M, "PIECE", 64)
    assert M.fingerprint(text).tolist() == whole == brute(text)
    monkeypatch.setattr(M, "PIECE", 1)
    assert M.fingerprint(text[:50]).tolist() == brute(text[:50])


def test_long_text_without_places():
    """Beyond PLACE_BITS positions k-mers are brought together by another sort, with the same numbers."""
    found = M.kmers("abcab" * 50, 3)
    grams, places, hashes = M._numbered(found)
    order = np.argsort(found, kind="stable")
    assert (places == order).all() and (grams == found[order]).all() and len(set(hashes.tolist())) == len(hashes)


def test_order_matters_and_edits_show():
    rng = np.random.default_rng(1)
    text = "".join(chr(97 + c) for c in rng.integers(0, 26, 4000))
    like = lambda other: float(np.mean(M.fingerprint(text, M.Settings(size=512)) == M.fingerprint(other, M.Settings(size=512))))
    swapped = text[2000:] + text[:2000]  # nearly the same set of k-mers
    edits = lambda n: "".join("#" if i in set(rng.choice(4000, n, replace=False).tolist()) else c for i, c in enumerate(text))
    few, many = edits(20), edits(200)
    assert like(text) == 1 and 0.4 < like(swapped) < 0.6 < like(few) and like(many) < like(few)
    assert like(text[::-1]) < 0.05


def texts_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("part", F.lit("own"))


def loop(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for k, (i, t) in enumerate(rows):
        following, n = rows[(k + 1) % len(rows)][1], len(t) // 4
        changed = t[: len(t) - n] + following[:n]
        a, b, c = (np.array(brute(x)) for x in (t, changed, following))
        out[i] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), a.astype("<u4").tobytes(), b.astype("<u4").tobytes(), np.mean(a == b), np.mean(a == c))
    return out


def test_with_edits(spark):
    rows = [(None, "of no id " * 5), (7, None), (3, ""), (10, "ten " * 30), (-4, "below zero, " * 9), (8, "é你🙂" * 40), (9, "é你🙂" * 40), (12, "short"), (11, "x")]
    got = {r["doc_id"]: tuple(bytes(x) if isinstance(x, bytearray) else x for x in r[1:]) for r in M.with_edits(texts_of(spark, rows)).collect()}
    assert got == loop(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = loop(rows[:40])
    few = texts_of(spark, rows[:40])
    got = {r["doc_id"]: r for r in M.with_edits(few).collect()}
    assert all(tuple(got[i][1:3]) == w[:2] and bytes(got[i]["edited_fingerprint"]) == w[3] and (got[i]["near_edited"], got[i]["near_next"]) == w[4:] for i, w in want.items())
    whole = {r["doc_id"]: r for r in queries.QUERIES["op11_order_minhash"](spark, SF).collect()}
    assert len(whole) == len(rows) and {i: r["fingerprint"] for i, r in whole.items()} == {i: M.fingerprint(t or "").tobytes().hex() for i, t in rows}
    copies = {}
    for i, t in rows:
        assert copies.setdefault(t, whole[i]["fingerprint"]) == whole[i]["fingerprint"]


def test_repeated_rows_empty_and_single(spark):
    rows = [(1, "one text of some length"), (1, "one text of some length"), (1, "another text of some length"), (2, "a second text")]
    got = M.with_edits(texts_of(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 1, 2] and sum(r["near_next"] == 1 for r in got) == 1
    assert M.with_edits(texts_of(spark, rows).where("false")).collect() == []
    (one,) = M.with_edits(texts_of(spark, rows[-1:])).collect()
    assert one["near_next"] == 1 and one["n_chars"] == 13


def test_likeness_column(spark):
    rows = [(1, "the first text, about this and that"), (2, "the first text, about this and what")]
    a, b = (r["signature"] for r in M.signatures(texts_of(spark, rows)).orderBy("doc_id").collect())
    (got,) = spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(M.likeness(F.col("a"), F.col("b"))).first()
    assert got == np.mean(np.array(a) == np.array(b)) and 0 < got < 1
    assert M.signatures(texts_of(spark, rows).where("false")).collect() == []


def test_very_long_text(spark):
    rows = [(1, "word " * 400_000), (2, "b" * 500_000)]
    got = {r["doc_id"]: r for r in M.with_edits(texts_of(spark, rows)).collect()}
    assert got[1]["n_chars"] == 2_000_000 and 0 < got[1]["near_edited"] < 1 and got[1]["near_next"] == 0

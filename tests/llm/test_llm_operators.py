"""Operators against brute force, on the smallest tables and on small cases with hot groups."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from parleyspark.llm import adaptive_rules, balance, class_lm, cover_tree, graph, hash_tree, line_runs, ordinal, packing, queries, semicrf, simhash
from parleyspark.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
JSON = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


def words(text):
    return text.encode().lower().split()


# --- 1: class bigrams ---------------------------------------------------------------
def test_base_scores(spark, texts):
    got = run(spark, "op1_class_bigrams").set_index("doc_id")
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in words(t))
    ends = sum(not h for h in held.values())
    n, below = sum(counts.values()) + ends, sum(counts.values()) + ends + 0.5 * (len(counts) + 2)
    for i, t in texts.items():
        row, found = got.loc[i], words(t)
        assert row["base_score"] == pytest.approx(sum(math.log10((c + 0.5) / below) for c in [*(counts[w] for w in found), ends]))
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (held[i], len(found) + 1, sum(w in counts for w in found) + 1, n)
    out = got[got["held_out"]]
    assert out["score"].sum() > out["base_score"].sum()  # classes help on texts that are held out


def test_class_scores_are_a_distribution(spark):
    """With every word known, the probabilities of all one-word texts and of what follows add up to one."""
    train = ["a b", "a c", "b a"] * 20
    all_texts = train + ["", "a", "b", "c"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(all_texts)], "doc_id bigint, text string")
    s = class_lm.Settings(clustered=10, classes=2, hot=10, rounds=3)
    got = {r["doc_id"]: 10 ** r["score"] for r in class_lm.score_documents(frame, F.col("doc_id") >= len(train), s).collect()}
    empty, *single = (got[len(train) + k] for k in range(4))
    assert 0 < empty < 0.2 and all(0 < p < 1 for p in single) and empty + sum(single) < 1


def test_exchange_raises_likelihood(spark):
    rows = [(i, " ".join(["x1 y1", "x2 y2", "x1 y2", "x2 y1"][(i + k) % 4] for k in range(5))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    mean = lambda rounds: np.mean([r["score"] for r in class_lm.score_documents(frame, F.lit(False), class_lm.Settings(clustered=4, classes=2, hot=4, rounds=rounds)).collect()])
    assert mean(4) >= mean(0)


def test_moves_put_alike_words_together():
    pairs = np.array([[5, 50, 0], [50, 5, 0], [0, 0, 10]])
    before, after = np.array([[0, 20, 0]]), np.array([[0, 20, 0]])  # follows and precedes class 1, but is in class 1
    assert class_lm.moves(np.array([7]), before, after, np.array([1]), pairs + np.array([[0, 0, 0], [0, 40, 0], [0, 0, 0]]), 2) == [(7, 0)]


# --- 2: entropy balancing -------------------------------------------------------------
def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        left, open_ = left - sum(2.0 * sizes[s] for s in over), open_ - over


def test_mix(spark, docs, texts):
    got, again = run(spark, "op2_entropy_balance"), run(spark, "op2_entropy_balance")
    assert (got["size"] == [len(words(texts[i])) for i in got["doc_id"]]).all() and (got["taken"] <= 2 * got["size"]).all()
    by = got.groupby("source")
    want = brute_targets(by["size"].sum().to_dict())
    assert by["target"].first().to_dict() == pytest.approx(want) and (by["source_size"].first() == by["size"].sum()).all()
    assert (abs(by["taken"].sum() - by["target"].first()) <= by["size"].max() / 2).all()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).to_numpy().tolist() == again[key].sort_values(key).to_numpy().tolist()


def test_mix_with_a_hot_source_and_null_source(spark):
    rows = [(i, None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 5}", "w " * (1 + i * i % 50)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = balance.mix(frame).toPandas()
    by = got.groupby("source", dropna=False)
    want = brute_targets({None if pd.isna(k) else k: v for k, v in by["mix_size"].sum().items()})
    taken = (got["mix_size"] * got["mix_copies"]).groupby(got["source"], dropna=False).sum()
    for source, n in taken.items():
        assert n == pytest.approx(want[None if pd.isna(source) else source], rel=2e-3)


def test_two_columns_of_targets_meet_both(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 300), ("b", "x", 200), ("b", "y", 50)], "s string, l string, size bigint")
    targets = {"s": spark.createDataFrame([("a", 300.0), ("b", 200.0)], "s string, target double"), "l": spark.createDataFrame([("x", 350.0), ("y", 150.0)], "l string, target double")}
    got = balance.multipliers(cells, targets)
    s, l = ({r[0]: r[1] for r in got[c].collect()} for c in ("s", "l"))
    rate = lambda a, b: math.exp(s[a] + l[b])
    assert 100 * rate("a", "x") + 300 * rate("a", "y") == pytest.approx(300) and 100 * rate("a", "x") + 200 * rate("b", "x") == pytest.approx(350)


# --- 3: SimHash -----------------------------------------------------------------------
def brute_components(fps):
    distinct = np.array(sorted(set(fps.values())), np.int64).view(np.uint64)
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1 :] ^ distinct[i]) <= 2):
            root[find(i)] = find(i + 1 + int(j))
    at = {int(f): k for k, f in enumerate(distinct.view(np.int64))}
    least = defaultdict(lambda: 1 << 60)
    for i, f in fps.items():
        least[find(at[f])] = min(least[find(at[f])], i)
    return {i: least[find(at[f])] for i, f in fps.items()}


def test_fingerprints(spark, texts):
    got = run(spark, "op3_segment_simhash").set_index("doc_id")
    for i, t in list(texts.items())[:60]:
        found = words(t)
        shingles = [b" ".join(found[k : k + 3]) for k in range(max(len(found) - 2, 1))]
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert got.loc[i, "fingerprint"] == f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"
    assert got["component_id"].to_dict() == brute_components({i: int(np.array(int(f, 16), np.uint64).view(np.int64)) for i, f in got["fingerprint"].items()})


@pytest.mark.parametrize("crowd", [1, 4, 32])
def test_links_in_crowded_cells(spark, crowd):
    """Fingerprints around a few centres: chains, crowded grid points, and pairs just beyond the distance."""
    draw = np.random.default_rng(3)
    fps = []
    for centre in draw.integers(0, 1 << 63, 4):
        for _ in range(60):
            x = int(centre)
            for bit in draw.choice(64, draw.integers(0, 5), replace=False):
                x ^= 1 << int(bit)
            fps.append(int(np.array(x & (2**64 - 1), np.uint64).view(np.int64)))
    fps += [0, -1, 3, 7, 15, (1 << 62) - 1]
    fps = dict(enumerate(sorted(set(fps))))
    nodes = spark.createDataFrame([(f,) for f in fps.values()], "fp bigint")
    found = {r["node"]: r["root"] for r in graph.components(simhash.fingerprint_links(nodes, crowd)).collect()}
    groups = defaultdict(set)
    for f in fps.values():
        groups[found.get(f, f)].add(f)
    want = defaultdict(set)
    for i, c in brute_components(fps).items():
        want[c].add(fps[i])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 600)] + [(900, 901)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 600)} | {900: 900, 901: 900}


# --- 4: adaptive rules -----------------------------------------------------------------
def test_sketches_merge_and_quantiles_are_close(spark):
    values = np.random.default_rng(0).lognormal(1, 1, 4000)
    rows = [("en", f"s{k % 4}", int(100 * v), 100) for k, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "lang string, source string, n_symbols bigint, n_words bigint").withColumns({c: F.lit(0) for c in ("n_dup_lines", "n_full_lines", "n_repeat_words")}).withColumn("word_chars", F.lit(500))
    rules = adaptive_rules.Rules(least=5000)  # no group is large enough: all are judged by all documents
    got = adaptive_rules.fences(adaptive_rules.sketches(frame, rules), rules).collect()
    rates = np.array([r[2] for r in rows]) / 100
    mid, high = np.quantile(rates, [0.5, 0.75])
    assert len(got) == 4 and all(r["high_symbol_rate"] == pytest.approx(high + 6 * (high - mid), rel=0.15) for r in got)


def test_junk_goes_and_clean_texts_stay(spark):
    joined = run(spark, "op4_adaptive_rules").merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    passed = joined[~joined["base_failed"]]
    assert passed[passed["quality"] == 1]["kept"].all()
    assert not passed[(passed["quality"] == 0) & (passed["n_symbols"] > passed["n_words"])]["kept"].any()


# --- 5: toxicity ------------------------------------------------------------------------
def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = ordinal.train(docs, labels.where("doc_id % 4 <> 0"))
    got = ordinal.severity(docs, model).toPandas().rename(columns={"toxic": "found"}).merge(labels.where("doc_id % 4 = 0").toPandas(), on="doc_id")
    assert got[got["toxic"] == 0]["found"].mean() < 0.02
    clean, toxic = (got[got["toxic"] == k]["expected_severity"] for k in (0, 1))
    assert (toxic.to_numpy()[:, None] > clean.to_numpy()[None, :]).mean() > 0.9


def test_thresholds_are_ordered_and_severity_follows():
    draw = np.random.default_rng(1)
    toxic, found = [], []
    for k in range(400):
        bad = k % 4 == 0
        found.append(np.array([*draw.integers(100, 200, 20), *(draw.choice(np.arange(1, 9), int(draw.integers(1, 9)), replace=False) if bad else [])], np.int32))
        toxic.append(int(bad))
    model = ordinal.fit(np.array(toxic), found, ordinal.Settings(bits=10, least=2))
    assert (np.diff(model.thresholds) > 0).all()
    margin = np.array([model.weights[x].sum() for x in found])
    up = model.above(margin)
    assert (np.diff(up, axis=1) <= 0).all() and (((up[:, 0] > 0.5) == np.array(toxic)).mean()) > 0.97
    assert up.sum(1)[np.argmax([(x < 9).sum() for x in found])] > up.sum(1)[4]


# --- 6: hash tree -------------------------------------------------------------------------
def test_shards(spark, texts):
    got = run(spark, "op6_hash_tree").set_index("doc_id")
    for i, t in texts.items():
        assert (got.loc[i, "size"], got.loc[i, "text_crc32"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
    assert all(sorted(x["slot"]) == list(range(len(x))) for _, x in got.groupby("shard"))
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) <= {24} and set(got["shard"]) <= set(range(24))


def test_tree_balance_and_movement(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    leaves = hash_tree.tree(24)
    heavier = [hash_tree.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 0.0 if x.shard == 9 else 1.0) for x in leaves]
    got = keys.select(hash_tree.place(F.col("k"), leaves).alias("a"), hash_tree.place(F.col("k"), heavier).alias("b")).select("a.*", F.col("b.shard").alias("to")).toPandas()
    assert got["shard"].value_counts().between(700, 970).all() and got["region"].value_counts().between(4600, 5400).all()
    moved = got[got["shard"] != got["to"]]
    assert ((moved["to"] == 5) | (moved["shard"] == 9)).all()  # only into the heavier shard and out of the one without weight
    assert (got["to"] == 5).mean() == pytest.approx(3 / 25, abs=0.01)
    # inner nodes draw by the weight of their subtree
    assert all({(x.region, x.rack) for x in leaves if x.shard == s} == set(map(tuple, g[["region", "rack"]].drop_duplicates().to_numpy())) for s, g in got.groupby("shard"))


# --- 7: cover trees -------------------------------------------------------------------------
@pytest.mark.parametrize("kind", ["spread", "clusters", "equal", "large"])
def test_dual_tree_is_exact(kind):
    draw = np.random.default_rng(5)
    points = {"spread": draw.integers(-99, 99, (700, 6)), "clusters": draw.integers(-3, 3, (700, 6)) + 50 * draw.integers(-2, 2, (10, 6))[draw.integers(0, 10, 700)], "equal": np.ones((300, 4), int), "large": draw.integers(-(2**28), 2**28, (200, 5))}[kind].astype(np.float64)
    ids = draw.permutation(len(points)).astype(np.int64)
    rows = np.arange(0, len(points), 7)
    got = cover_tree.search(points[rows], ids[rows], points, ids, 5)
    whole = points.astype(np.int64)
    for r in rows:
        scores = whole @ whole[r]
        want = sorted(((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != ids[r]))[:5]
        assert sorted((-s, i) for q, i, s in got if q == ids[r]) == want


def test_tree_covers():
    points = np.random.default_rng(2).normal(size=(500, 5))
    tree = cover_tree.Tree(points)
    for node, (lo, hi) in enumerate(tree.span):
        away = np.linalg.norm(points[tree.order[lo:hi]] - points[tree.centre[node]], axis=1)
        assert away.max() <= tree.radius[node] + 1e-9
        if tree.children[node] is not None:
            assert sorted(tree.span[c] for c in tree.children[node])[0][0] == lo and sum(b - a for a, b in (tree.span[c] for c in tree.children[node])) == hi - lo


def test_blocks_give_the_same(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    wanted = F.col("vec_id") % 50 == 0
    one, many = (sorted(map(tuple, cover_tree.top_k(table, wanted, block=b).collect())) for b in (10_000, 7))
    assert one == many


# --- 8: line runs -----------------------------------------------------------------------------
def brute_lines(texts, least=3):
    clean = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({65 + k: 97 + k for k in range(26)})
    holders = defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(clean(line)) >= 20:
                holders[clean(line)].add(i)
    owner = {k: max(v) for k, v in holders.items() if len(v) >= least}
    return {i: "\n".join(line for line in (t or "").split("\n") if owner.get(clean(line), i) == i) for i, t in texts.items()}


@pytest.mark.parametrize("batches", [1, 3, 9])
def test_lines_against_brute_force(spark, batches):
    shared = "  This line is SHARED by many of the documents\r"
    texts = {i: "\n".join([f"line {i} of its own, long enough to count", *([shared] * (i % 3)), "short", *(["É marks stay as they are in keys"] if i % 4 == 0 else []), ""]) for i in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["kept_text"] for r in line_runs.dedup_lines(frame, batches=batches).collect()}
    assert got == brute_lines(texts)


def test_runs_compact_and_count(spark):
    batches = [[(4, 7, 7)], [(3, 5, 5), (3, 7, 7)], [(2, 5, 5)], [(1, 5, 5), (1, 6, 6)], [(0, 5, 5)]]
    for least, want in ((3, [(5, 5, 3)]), (2, [(5, 5, 3), (7, 7, 4)])):
        runs = line_runs.LineRuns(spark, buckets=2, least=least, fanout=2)
        for rows in batches:
            runs.add(spark.createDataFrame(rows, "doc_id bigint, h bigint, g bigint"))
        assert [len(x) for x in runs.levels] == [1, 0, 1]
        assert sorted(map(tuple, runs.shared().collect())) == want
        runs.close()


def test_settled_hashes_leave_a_batch(spark):
    """A run takes no hash that an earlier one settles with an owner as large; a larger owner is still taken."""
    runs = line_runs.LineRuns(spark, buckets=2, fanout=9)
    entries = lambda rows: spark.createDataFrame(rows, "doc_id bigint, h bigint, g bigint")
    runs.add(entries([(d, 1, 1) for d in (90, 91, 92)] + [(90, 2, 2), (90, 3, 3), (91, 3, 3)]))
    runs.add(entries([(50, 1, 1), (51, 1, 1), (50, 2, 2), (50, 3, 3), (50, 4, 4)]))
    runs.add(entries([(95, 1, 1), (20, 2, 2), (None, 1, 1)]))
    runs.add(entries([(94, 1, 1), (None, 1, 1), (10, 2, 2)]))
    stored = [sorted((r["h"], r["n"], r["owner"]) for r in run.collect()) for run in runs.runs()]
    assert stored == [[(1, 3, 92), (2, 1, 90), (3, 2, 91)], [(2, 1, 50), (3, 1, 50), (4, 1, 50)], [(1, 2, 95), (2, 1, 20)], [(1, 2, 94), (2, 1, 10)]]
    assert sorted(map(tuple, runs.shared().collect())) == [(1, 1, 95), (2, 2, 90), (3, 3, 91)]
    runs.close()


def test_shared_lines_are_stored_in_few_runs(spark, monkeypatch):
    """Of a line that all documents share, only the first run keeps a row; ids are taken from the largest on."""
    sizes = []
    monkeypatch.setattr(line_runs.LineRuns, "_place", lambda self, name, level: (sizes.append(self.spark.table(name).count()), self.levels.append([name])))
    docs = spark.range(80).selectExpr("id AS doc_id", "'a line that every document holds' AS text")
    got = line_runs.dedup_lines(docs, batches=8)
    assert sizes == [1, 0, 0, 0, 0, 0, 0, 0] and [r["doc_id"] for r in got.where("dropped_count = 0").collect()] == [79]


@pytest.mark.parametrize("kind", ["string", "double"])
def test_lines_of_other_ids(spark, kind):
    texts = {i: f"shared line over all of the rows\nown line of the row number {i}" for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    left = line_runs.dedup_lines(docs).where("dropped_count = 0").select(F.col("doc_id").cast("string")).collect()
    assert [r[0] for r in left] == [max(str(i) for i in texts) if kind == "string" else "29.0"]


# --- 9: packing ---------------------------------------------------------------------------------
def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer(JSON).path)
    got = run(spark, "op9_best_fit_packing")
    sequences = defaultdict(dict)
    for r in got.itertuples():
        sequences[r.sequence_id][r.offset] = r.length
        ids = np.array([*own.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")[r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
    for places in sequences.values():
        at = 0
        for offset in sorted(places):
            assert offset == at
            at += places[offset]
        assert at <= 2048
    assert len(sequences) <= 1.03 * math.ceil(got["length"].sum() / 2048) + 1


def test_later_rounds(spark, docs):
    """Many small rounds give gapless sequences too."""
    got = packing.pack(docs.repartition(6), tokenizer(), open_bins=3, per_task=5).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048 and len(got) >= docs.count()


def test_best_fit():
    bins = packing.Bins(10, 2)
    assert [bins.add(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.Bins(10, 2)
    assert [bins.add(n)[0] for n in (6, 7, 9, 4)] == [0, 1, 2, 0]  # bin 1 was the fullest and closed
    assert bins.left() == {2: 9}
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(2048, 2048) == [(0, 2048)]


def test_both_tokenizers_give_the_same_ids(texts):
    from tokenizers import Tokenizer

    plain, t = Tokenizer.from_file(tokenizer(JSON).path), tokenizer()
    own = packing.encoder(t.path, t.pattern, t.special, t.special_id)
    cases = ["", " ", "a  b", "a b\n c \n\n d", "x y  z", " lead", "trail ", "it's we'll  12 345", "<|endoftext|> a <|endoftext|>", "<|endoftext", "é\t\tñ 你好 \n", "a \n b", "\n \n", "A" * 30_000, "\u00a0\u2003x\u200b", "\U0001f600 \u0301 ٣ ⅷ"]
    for text in [*cases, *texts.values()]:
        assert own(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# --- 10: personal data --------------------------------------------------------------------------
TRICKY = [
    "a@b.com_foo@x.org c@d..e f@@g.hh .@h.i j@k.l-m.n@o.pp", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256.7 01.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 +1 (444) 555-3382 9.9.9.9",
    "+12+345678901 + 123 +1-2-3-4-5-6-7-8-9-", "x" * 3000 + "@" + "y" * 3000 + ".z", "1" * 4000, "é" * 5 + "q@r.ss", "+44 20 7946 0958 4539 1488 0343 6467 a@b",
]


def test_base_spans_are_those_of_the_patterns():
    import re

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    valid = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and semicrf.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    for text in TRICKY:
        want = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if valid[k](m.group())]
        assert semicrf.base_spans(text) == want, text


def test_field_adds_what_patterns_miss(spark):
    sf = "/root/testdata/sf0.1"
    field = semicrf.train(spark.read.parquet(f"{sf}/documents.parquet"), semicrf.Settings())
    text = "ereth anou (212) 555-0147 heat, ofer john.doe (at) mail3.example (dot) com nder 4111.1111.1111.1111 with 12 of 345 and 2021 or 7695f98391c04c2f5d"
    got = {(k, text[a:b]) for k, a, b in field.spans(text)}
    assert {("phone", "(212) 555-0147"), ("card", "4111.1111.1111.1111")} <= got and not any("7695" in x or x in ("12", "345", "2021") for _, x in got)
    assert any(k == "email" and x.startswith("john.doe") for k, x in got)

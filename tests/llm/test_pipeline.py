"""Every stage of the pipeline against brute force, each on what the stage before it kept."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest
from test_llm_operators import brute_lines, brute_targets, words

import corpus_pipeline
from parleyspark.llm.common import keep
from parleyspark.llm.queries import TWINS, tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """Rows of documents, then of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF))
        out.append(docs.toPandas())
    return out


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mix", "best_fit_packing"]


def test_quality_rules(results):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({TWINS['op4_adaptive_rules']}) WHERE kept").fetchall()}
    before, after = results[0].set_index("doc_id"), results[1].set_index("doc_id")
    assert set(after.index) == kept and after["text"].equals(before.loc[after.index, "text"])


def test_line_dedup(results):
    before, after = results[1].set_index("doc_id")["text"], results[2].set_index("doc_id")
    assert after["text"].to_dict() == brute_lines(before.to_dict())
    assert (after["text"].map(len) == after["n_chars"]).all()


def shingles(text):
    found = words(text)
    return {tuple(found[k : k + 5]) for k in range(max(len(found) - 4, 1))} if found else set()


def test_near_dedup(results):
    """Brute-force Jaccard similarity of all pairs; the least doc_id of each component stays."""
    sets = {i: shingles(t) for i, t in results[2].set_index("doc_id")["text"].items()}
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and (x == y or len(x & y) >= 0.8 * len(x | y)):
                low, high = sorted((root(a), root(b)))
                name[high] = low
    assert sorted(results[3]["doc_id"]) == [i for i in sorted(sets) if root(i) == i]


def test_source_mix(results):
    before, after = results[3].set_index("doc_id"), results[4]
    copies = Counter(after["doc_id"])
    assert set(copies) <= set(before.index) and max(copies.values()) <= 2
    assert (after["text"].to_numpy() == before.loc[after["doc_id"], "text"].to_numpy()).all()
    sizes = before["text"].map(lambda t: len(words(t)))
    want = brute_targets(sizes.groupby(before["source"]).sum().to_dict())
    taken = defaultdict(int)
    for i, n in copies.items():
        taken[before.loc[i, "source"]] += n * sizes[i]
    for source, target in want.items():
        assert abs(taken[source] - target) <= sizes[before["source"] == source].max() / 2


def test_packing(results):
    from tokenizers import Tokenizer

    own, pieces = Tokenizer.from_file(tokenizer("byte_bpe_50k.json").path), results[5]
    lengths = {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in zip(results[4]["doc_id"], results[4]["text"], strict=True)}
    copies = Counter(results[4]["doc_id"])
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == {i: n * copies[i] for i, n in lengths.items()}
    placed = pieces.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all()
    assert placed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert pieces["sequence_id"].nunique() <= 1.03 * math.ceil(pieces["length"].sum() / 2048) + 1


def test_run_gives_the_last_stage(spark, results):
    assert corpus_pipeline.run(spark, SF).count() == len(results[5])

"""Operators give what they name: ids of packed sequences, rows in their shards."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from parleyspark.llm import hash_tree, packing
from parleyspark.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


def test_sequences_hold_the_ids_of_their_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(docs.limit(5))  # rows that only their place tells apart
    pieces = packing.pack(docs.repartition(3), tokenizer(), open_bins=4, per_task=8)
    packing.write_sequences(pieces, f"{tmp_path}/sequences")
    t = tokenizer()
    encode = packing.encoder(t.path, t.pattern, t.special, t.special_id)
    want, got, n = defaultdict(list), defaultdict(list), 0
    for r in docs.collect():
        want[r["doc_id"]].append([*np.frombuffer(encode(r["text"]), "<u4"), 0])
    parts = defaultdict(list)
    for r in spark.read.parquet(f"{tmp_path}/sequences").collect():
        assert len(r["ids"]) == sum(p["length"] for p in r["pieces"]) <= 2048
        n += len(r["ids"])
        for p in r["pieces"]:
            parts[p["doc_id"], p["start"]].append(r["ids"][p["offset"] : p["offset"] + p["length"]])
    assert n == sum(len(x) for copies in want.values() for x in copies)
    for i, start in sorted(parts):
        got[i].append(parts[i, start])
    for i, copies in want.items():
        assert all(len(p) == len(copies) and all(x == p[0] for x in p) for p in got[i])
        assert [x for p in got[i] for x in p[0]] == copies[0]


def test_rows_reach_their_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"shard": F.lit("own"), "before": F.lit(1)})
    out = hash_tree.shard_documents(docs, hash_tree.tree(6))
    assert out.columns == [*docs.columns, "size", "region", "rack", "shard_", "slot", "grown_shard"]
    hash_tree.write_shards(out, f"{tmp_path}/shards", shard="shard_")
    got = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(got.select(*docs.columns).collect()) == sorted(docs.collect())
    one = spark.read.parquet(f"{tmp_path}/shards/region=1/rack=0/shard_=1").toPandas()
    assert sorted(one["slot"]) == list(range(len(one))) and len(one) > 0
    assert one.sort_values("slot")["doc_id"].is_monotonic_increasing

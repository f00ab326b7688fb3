"""Streams over tables that are folders of parts read all of them, as they do a single file."""

import shutil

import pytest
from pyspark.sql import functions as F

from parleyspark.plans import stream_queries as St


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows = [(c, t, "user" if t else "system", f"you are a clown number {c} of {t}, friend") for c in range(6) for t in range(5)]
    conversations = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    events = spark.createDataFrame([(i, i % 7, f"kind{i % 3}") for i in range(60)], "event_id bigint, user_id bigint, event_type string")
    for name, df in {"conversations": conversations, "events": events}.items():
        df.repartition(4).write.parquet(f"{root}/parts/{name}.parquet")
        df.coalesce(1).write.parquet(f"{root}/one/{name}")
        (file,) = (root / "one" / name).glob("part-*.parquet")
        shutil.copy(file, root / "one" / f"{name}.parquet")
    return str(root / "one"), str(root / "parts")


@pytest.mark.parametrize("run, least", [(St.stream_incidents, 1), (St.stream_window_state, 20), (St.stream_seen_dedup, 7)])
def test_folder_of_parts_reads_as_one_file(spark, folders, run, least):
    file, parts = (sorted(map(str, run(spark, f).select("*").collect())) for f in folders)
    assert len(file) >= least and parts == file


def test_stream_has_every_row(spark, folders):
    for f in folders:
        out = St.run_to_table(St.table_stream(spark, f, "conversations").select("conv_id", F.col("turn")), St.run_folder(spark))
        assert out.count() == 30

import pytest
from pyspark.sql import functions as F

from parleyspark.sources import frozen as Z
from parleyspark.sources.chunks import ChunkedJob
from parleyspark.sources.files import matching

SCHEMA = "thread_id string, length int, script string, label string, split string, turns array<string>"


def threads(spark, n=20):
    rows = [(str(i), 2 + i % 2, "english", None if i == 3 else "a b", ("train", "val", "test")[i % 3], [f"t{i}", "x/y = z"]) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_frozen_set_is_whole_and_intact(spark, tmp_path):
    rows, path = threads(spark), str(tmp_path / "set")
    Z.freeze(rows, path)
    facts = Z.check(spark, path, rows.schema).collect()
    assert all(r["intact"] and r["rows"] == r["found"] for r in facts)
    for layout in (Z.FLAT, Z.TREE):
        assert sum(r["rows"] for r in facts if r["layout"] == layout) == 20
    got = Z.read_frozen(spark, path, rows.schema)
    assert got.exceptAll(rows).isEmpty() and rows.exceptAll(got).isEmpty()
    assert Z.read_frozen(spark, path, rows.schema, "test").count() == 6
    with pytest.raises(FileExistsError):
        Z.freeze(rows, path)
    Z.freeze(threads(spark, 5), path, replace=True)
    assert Z.read_frozen(spark, path, rows.schema).count() == 5


@pytest.mark.parametrize("change", ["word", "repeat", "remove"])
def test_change_of_a_split_is_seen_by_its_readers_only(spark, tmp_path, change):
    rows, path = threads(spark), str(tmp_path / "set")
    Z.freeze(rows, path)
    part = spark.createDataFrame(rows.filter("split = 'test'").collect(), SCHEMA)
    new = {"word": part.withColumn("turns", F.transform("turns", F.upper)), "repeat": part.unionByName(part).unionByName(part), "remove": part.filter("length = 2")}[change]
    new.write.mode("overwrite").json(f"{path}/{Z.FLAT}/_split=test")
    with pytest.raises(ValueError, match="altered"):
        Z.read_frozen(spark, path, rows.schema, "test")
    assert Z.read_frozen(spark, path, rows.schema, "train").count() == 7
    bad = Z.check(spark, path, rows.schema).filter("NOT intact").collect()
    assert bad and {(r["layout"], r["split"]) for r in bad} == {(Z.FLAT, "test")}


def test_nothing_is_frozen_without_a_manifest(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Z.check(spark, str(tmp_path / "none"), threads(spark).schema)


def test_stopped_job_goes_on(spark, tmp_path):
    rows = spark.range(1000).withColumn("v", F.col("id") * 2)
    seen = []

    def work(df):
        seen.append(sorted(r["id"] for r in df.select("id").collect()))
        return df

    job = ChunkedJob(spark, str(tmp_path / "job"), "id", chunks=5)
    first = job.run(rows, work, stop_after=2)
    assert [c for c, _ in first] == [0, 1] and sum(n for _, n in first) < 1000
    second = ChunkedJob(spark, str(tmp_path / "job"), "id", chunks=9).run(rows, work)  # the first run's bounds stay
    assert [c for c, _ in second] == [2, 3, 4]
    assert sorted(i for s in seen for i in s) == list(range(1000))
    got = job.result()
    assert {(r["id"], r["v"]) for r in got.collect()} == {(i, 2 * i) for i in range(1000)} and got.count() == 1000
    assert job.run(rows, work) == []
    assert {r["chunk"]: r["rows"] for r in job.ledger().collect()} == dict(first + second)


def test_broken_part_is_done_again_and_late_rows_are_taken(spark, tmp_path):
    rows, path = spark.range(100), str(tmp_path / "job")
    job = ChunkedJob(spark, path, "id", chunks=4)

    def fails(df):
        if df.filter("id = 60").isEmpty():
            return df
        return df.withColumn("id", F.when(F.col("id") == 60, F.raise_error(F.lit("broken"))).otherwise(F.col("id")))

    with pytest.raises(Exception, match="broken"):
        job.run(rows, fails)
    left = job.result().count()
    assert 0 < left < 60
    late = rows.unionByName(spark.sql("SELECT -5L AS id UNION ALL SELECT 500L UNION ALL SELECT 500L UNION ALL SELECT NULL"))
    job.run(late, lambda df: df)
    assert sorted((r["id"] is None, r["id"] or 0) for r in job.result().collect()) == sorted((i is None, i or 0) for i in [*range(100), -5, 500, 500, None])
    assert len(matching(spark, f"{path}/chunk=*/part-*")) == len(matching(spark, f"{path}/chunk=*/part-*/_SUCCESS"))
    assert job.run(late, lambda df: df) == []


def test_job_over_nothing(spark, tmp_path):
    job = ChunkedJob(spark, str(tmp_path / "job"), "id", chunks=3)
    assert job.run(spark.range(0), lambda df: df) == []
    with pytest.raises(FileNotFoundError):
        job.result()

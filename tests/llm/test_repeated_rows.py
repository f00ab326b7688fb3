"""Rows of one doc_id are one document to line dedup, as to its SQL twin."""

import duckdb
import pytest

from parleyspark.llm import line_runs
from parleyspark.llm.queries import TWINS

LINE = "a line that is long enough to count"
OTHER = "another line that is long enough as well"


@pytest.mark.parametrize("batches", [1, 4])
def test_repeated_rows_count_once(spark, batches):
    rows = [(1, LINE), (1, LINE), (2, LINE), (3, f"{OTHER}\nown of three"), (4, OTHER), (5, f"{OTHER}\n{LINE.upper()} not"), (5, f"{OTHER}\nx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["text"]): r["dropped_count"] for r in line_runs.dedup_lines(docs, batches=batches).collect()}
    assert got[1, LINE] == got[2, LINE] == 0 and got[4, OTHER] == 1 and got[3, rows[3][1]] == 1 and got[5, rows[6][1]] == 0
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r[0]: r[2] for r in con.execute(TWINS["op8_line_runs"]).fetchall()}
    sums = {i: sum(got[k] for k in map(tuple, rows) if k[0] == i) for i in want}
    assert sums == want

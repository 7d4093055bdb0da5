"""Items with a null id hit words like others; the oracle of op3 says the same."""

import duckdb
import pytest
from helpers import got, order, table
from test_benchmark_pii_toxicity import contaminated, hits

from cohortlens.llm import decontaminate, queries

ITEM = "one two three four five six seven eight nine ten eleven"


@pytest.mark.parametrize("block", [1 << 20, 5])
def test_items_with_null_ids_count(spark, block):
    asked = spark.createDataFrame([(None, ITEM), (7, "alpha beta")], "item_id long, text string")
    docs = [(1, f"start {ITEM} end"), (2, "an alpha beta here"), (3, f"alpha beta {ITEM}"), (4, "nothing")]
    df = decontaminate.find(table(spark, docs), asked, block_bytes=block)
    assert got(df, "doc_id", "n_words", "n_hit", "n_items", "items", "longest") == order(
        [(1, 13, 11, 0, [], 11), (2, 4, 2, 1, ["7"], 2), (3, 13, 13, 1, ["7"], 11), (4, 1, 0, 0, [], 0)])
    left = decontaminate.remove(table(spark, docs), asked, max_coverage=1.0, block_bytes=block)
    assert got(left, "doc_id", "text") == [(1, "start  end"), (2, "an  here"), (3, ""), (4, "nothing")]


def test_query_and_oracle_agree_on_null_ids(spark, tmp_path):
    con = duckdb.connect()
    docs = [(1, f"start {ITEM} end"), (2, "nothing"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, ITEM), (7, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    df = queries.op3_decontamination(spark, str(tmp_path))
    want = con.execute(queries.ORACLES["op3_decontamination"]).fetchall()
    assert got(df, *df.columns) == order(want) and [r[5] for r in order(want)] == [True, False, False]


def test_null_ids_against_window_search(spark):
    """The table of test_contamination_matches_window_search, with the null id under a name."""
    docs, items = contaminated(9)
    asked = spark.createDataFrame(items, "item_id long, text string")
    df = decontaminate.find(table(spark, docs), asked, window=9)
    named = [(-1 if i is None else i, t) for i, t in items]
    want = []
    for i, text in docs:
        n, hit, _, names, _ = hits(text, named, 9)
        want.append((i, n, hit, [x for x in names if x != "-1"]))
    assert got(df, "doc_id", "n_words", "n_hit", "items") == order(want)

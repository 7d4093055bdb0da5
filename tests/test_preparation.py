"""The prepared model table: partitions are merged only once its rows are finished."""

from cohortlens.operators import models as M
from cohortlens.plans import models as P


def tables(spark, folder, n=60):
    docs = [(i, f"Word {i} " * (1 + i % 7) + "\nLINE", ("en", "es", None)[i % 3], 10 + i) for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars int").repartition(6).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_merged_partitions_only_read_finished_rows(spark, tmp_path, monkeypatch):
    merged = []
    merge = M.few_partitions
    monkeypatch.setattr(M, "few_partitions", lambda df, n: merged.append((df, n)) or merge(df, n))
    got = P.everything(spark, tables(spark, tmp_path))
    (source, n), = merged
    plan = source._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Filter" not in plan and "Union" not in plan and "ExistingRDD" in plan
    assert n == 60 and source.rdd.getNumPartitions() > 1 and got.rdd.getNumPartitions() == 1
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(60))
    assert sum(r["is_test"] for r in rows) == 18 and all((r["fold"] == -1) == (r["is_test"] == 1) for r in rows)

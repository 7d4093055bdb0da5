import re

import corpus_pipeline
from helpers import got
from test_benchmark_pii_toxicity import hits
from test_duplicates import linked

from cohortlens.llm import pii, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one_against_brute_force(spark):
    spark.conf.set(queries.PSEUDONYM_KEY, "a key")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    tables = [docs.collect()]
    current = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = spark.createDataFrame(stage(spark, current, SF).collect(), docs.schema)
        assert current.columns == columns
        tables.append(current.collect())
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, queries.toxicity_machine(spark, SF)).collect()}
    given, mild, single, clean, private = ([(r["doc_id"], r["text"]) for r in t] for t in tables)
    assert sorted(mild) == sorted(x for x in given if scores[x[0]] < 0.5)
    assert sorted(single) == sorted(x for x, (i, size, c) in zip(mild, linked(mild), strict=True) if not size or i == c)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = dict(single)
    for i, text in clean:
        n, hit, *_ = hits(before[i], items, 10)
        assert text == before[i] if not hit else hit <= 0.5 * n and not hits(text, items, 10)[1]
    assert {i for i, _ in single} - {i for i, _ in clean} == {i for i, t in single if hits(t, items, 10)[1] > 0.5 * max(1, hits(t, items, 10)[0])}
    change = pii.Pseudonymizer(b"a key")
    assert dict(private) == {i: change(t)[0] for i, t in clean}
    assert all(r["n_chars"] == len(r["text"]) for r in tables[-1])
    last = corpus_pipeline.STAGES[-1][1](spark, current, SF).collect()
    assert {r["doc_id"] for r in last} == {i for i, _ in private} and all(r["round_trip"] for r in last)


def test_run_gives_the_rows_of_the_stages(spark):
    ran = corpus_pipeline.run(spark, SF)
    current = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, SF)
    assert got(ran, "doc_id", "n_pieces") == got(current, "doc_id", "n_pieces")
    assert re.fullmatch(r"[a-z_]+", corpus_pipeline.STAGES[0][0])


def test_entry_registers_every_operator():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n for n in range(1, 11) if any(x.startswith(f"op{n}_") for x in names)} == set(range(1, 11))
    assert "pipeline" in names and set(entry.oracle_sql()) <= names

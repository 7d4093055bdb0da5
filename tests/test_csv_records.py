"""CSV files with line breaks in fields, read in many blocks, against Spark's one-task reader."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.sources import io as IO
from cohortlens.sources.records import inside_after, read_records


@pytest.fixture
def blocks(spark):
    """Blocks of few bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def set_(size):
        for n, v in zip(names, (str(size), "1", "1"), strict=True):
            spark.conf.set(n, v)

    yield set_
    for n, v in old.items():
        spark.conf.set(n, v) if v else spark.conf.unset(n)


def text(rng):
    return "".join(rng.choice(["a", "é", ",", '"', "\n", "\r\n", " ", "漢", "x1"]) for _ in range(rng.choice([0, 1, 3, 40, 400])))


@pytest.mark.parametrize(("size", "end"), [(37, "\n"), (300, "\r\n"), (1 << 20, "\n")])
def test_many_blocks_read_what_one_task_reads(spark, blocks, tmp_path, size, end):
    rng = random.Random(size)
    rows = [(str(i), text(rng), rng.choice(["", "NA", "1.5", text(rng)])) for i in range(120)]
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for part in range(3):
        with open(folder / f"part-{part}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=end)
            # a header that goes over many blocks
            out.writerow(["id", "text", "other" if part else "other"])
            out.writerows(rows[40 * part:40 * part + 40])
    schema = "id string, text string, other string"
    one = spark.read.options(header=True, multiLine=True, quote='"', escape='"', nullValue="﷐").schema(schema).csv(str(folder))
    want = sorted(tuple(r) for r in one.collect())
    blocks(size)
    df = IO.read_table(spark, str(folder), schema=schema, na_tokens=None)
    assert sorted(map(tuple, df.collect())) == sorted((i, t or None, o or None) for i, t, o in rows)
    # where lines end with CR LF, that reader turns these in fields into LF; here they stay
    assert end != "\n" or sorted(map(tuple, df.collect())) == want
    if size < 1000:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20


def test_headers_and_fields_longer_than_blocks(spark, blocks, tmp_path):
    long = "line\n" * 300
    path = tmp_path / "l.csv"
    path.write_text(f'id,"te\nxt{"y" * 90}\n"\n1,"{long}"\n\n2,plain\n3,"{long}"', encoding="utf-8")
    blocks(50)
    df = IO.read_table(spark, str(path), schema="id long, text string", na_tokens=None)
    assert sorted(map(tuple, df.collect())) == [(1, long), (2, "plain"), (3, long)]
    assert read_records(spark, str(path), header=False).count() == 4


def test_quotes_within_plain_fields_open_nothing():
    assert not inside_after('5" pipe,2', False, ",") and not inside_after('a,b"c,"d"', False, ",")
    assert inside_after('a,"b', False, ",") and inside_after('still "" open', True, ",") and not inside_after('end",x', True, ",")
    assert inside_after('end","again', True, ",") and not inside_after('"a""",b', False, ",")
    assert inside_after('x;"y', False, ";") and not inside_after('x;"y', False, ",")


def test_a_run_written_twice_is_there_once(spark, tmp_path):
    base = str(tmp_path / "runs")
    df = spark.range(5)
    IO.write_run(df, base, "2024-01-01_00-00-00")
    IO.write_run(df.where("id < 2"), base, "2024-01-02_00-00-00")
    IO.write_run(df.where("id < 4"), base, "2024-01-01_00-00-00")
    got = IO.read_table(spark, base, fmt="parquet").groupBy("run_ts").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in got) == [2, 4]

"""CSV read in splits gives the rows of Python's csv module."""

import csv
import random

import pytest

from labelspark.sources.csv_records import read_csv, read_lines, records

FIELDS = ["plain", "", 'quo"te', "a,b", "two\nlines", "\n\n", 'end"\n"begin', "ünï", '""', "x" * 90, "tail\n", ",\n,"]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield spark
    for name in names:
        spark.conf.unset(name)


def write(path, rows, **form):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, **form).writerows(rows)


def random_rows(seed, n):
    rng = random.Random(seed)
    return [[f"L{i}", *(rng.choice(FIELDS) for _ in range(3))] for i in range(n)]


def python_rows(path):
    with open(path, newline="", encoding="utf-8") as f:
        return sorted(tuple(r) for r in list(csv.reader(f))[1:] if r)


def spark_rows(spark, path):
    return sorted(tuple(x or "" for x in r) for r in read_csv(spark, str(path)).collect())


@pytest.mark.parametrize("seed, ending, quoting", [(1, "\n", csv.QUOTE_ALL), (2, "\n", csv.QUOTE_MINIMAL), (3, "\r\n", csv.QUOTE_ALL)])
def test_one_file_in_many_tasks(small_splits, tmp_path, seed, ending, quoting):
    file = tmp_path / "a.csv"
    write(file, [["id", "Brand Name", "b", "c"], *random_rows(seed, 120)], lineterminator=ending, quoting=quoting)
    lines = read_lines(small_splits, str(file))
    assert lines.rdd.getNumPartitions() > 10
    assert spark_rows(small_splits, file) == python_rows(file)
    assert read_csv(small_splits, str(file)).columns == ["id", "Brand Name", "b", "c"]


def test_a_field_over_several_splits_and_blank_lines(small_splits, tmp_path):
    long = "start\n" + "\n".join("line of a long field" for _ in range(60)) + "\nend"
    file = tmp_path / "a.csv"
    file.write_text('\n\nid,text\n\nA,"' + long + '"\n\nB,"x"\n   \nC,y')
    got = dict(spark_rows(small_splits, file))
    assert got == {"A": long, "B": "x", "C": "y"}


def test_every_file_has_its_header_and_parity(small_splits, tmp_path):
    rows = random_rows(5, 90)
    for i in range(3):
        write(tmp_path / f"{i}.csv", [["id", "a", "b", "c"], *rows[i * 30 : i * 30 + 30]], quoting=csv.QUOTE_ALL, lineterminator="\n")
    assert spark_rows(small_splits, tmp_path) == sorted(tuple(r) for r in rows)


def test_only_lines_of_long_records_meet_again(spark):
    lines = spark.createDataFrame([("f", 0, 0, "h"), ("f", 0, 1, 'a,"x'), ("f", 7, 2, 'y"'), ("f", 7, 3, "b")], "file string, block long, at long, value string")
    got = {(r.block, r.at, r.record, r.is_head) for r in records(lines).collect()}
    assert got == {(0, 0, "h", True), (0, 1, 'a,"x\ny"', False), (7, 3, "b", False)}


def test_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a\n")
    assert spark_rows(spark, tmp_path / "a.csv") == []

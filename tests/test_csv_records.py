"""Splittable CSV read: records across line ends and blocks, headers per file."""

import csv
import io
import random

import pytest

from parcelgrid.sources.files import csv_lines, csv_records, offset_csv_column


def _field(rng):
    return rng.choice(["", "7", "x,y", 'say "hi"', "two\nlines", "a\n\nb\n", "plain"])


@pytest.mark.parametrize("split", ["134217728", "64"])
def test_records_are_those_of_the_csv_module(spark, scratch, split):
    rng, want = random.Random(7), {}
    for k in range(6):
        rows = [[_field(rng) if k % 2 else rng.choice(["1", "a", ""]) for _ in range(3)] for _ in range(40)]
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator="\n").writerows(rows)
        with open(f"{scratch}/f{k}.csv", "w", newline="") as fh:
            fh.write(out.getvalue())
        want[f"f{k}.csv"] = rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)  # 64: records reach over blocks
    try:
        got = csv_records(csv_lines(spark, scratch)).orderBy("file_name", "block", "line").collect()
        assert split != "64" or len({r.block for r in got}) > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = {}
    for r in got:
        found.setdefault(r.file_name, []).append(r.text)
    assert {f: [next(csv.reader([t], strict=True)) if "\n" not in t else next(csv.reader(io.StringIO(t, newline="")))
                for t in texts] for f, texts in found.items()} == want


def test_a_column_by_each_files_own_header(spark, scratch):
    files = {"a.csv": "A,MLS#\nskip,1\nskip,2\nx,5\ny,6\n", "b.CSV": 'MLS#,"A\nB"\n"q\nq",\n0,0\n8,x\n,y\n',
             "c.csv": "A,B\n1,2\n3,4\n5,6\n", "d.csv": "", "e.csv": "MLS#\n1\n", "f.csv": 'Z,MLS#\n,\n,\n1,"11 A"\n2,12\n',
             "g.csv": "MLS#,B\r\n1,1\r\n2,2\r\n3,3\r\n"}
    for name, text in files.items():
        with open(f"{scratch}/{name}", "w", newline="") as fh:
            fh.write(text)
    got = sorted(map(tuple, offset_csv_column(spark, scratch, "MLS#").collect()))
    assert got == [("a.csv", "5"), ("a.csv", "6"), ("b.CSV", "8.0"), ("f.csv", "11 A"), ("f.csv", "12"), ("g.csv", "3")]

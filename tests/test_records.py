"""Records of delimited files against Python's own reader, over many splits."""

import csv
import io
import random

import pytest

from tidyshelf.sources import catalog
from tidyshelf.sources.records import Quotes


def ends_inside(text, sep):
    """By a plain automaton over the characters."""
    state = "start"
    for c in text:
        if state == "quoted":
            state = "closing" if c == '"' else "quoted"
        elif state == "closing" and c == '"':
            state = "quoted"
        elif c == sep:
            state = "start"
        elif state == "start" and c == '"':
            state = "quoted"
        else:
            state = "cell"
    return state == "quoted"


@pytest.mark.parametrize("sep", [",", "|", "\t", ";"])
def test_state_of_a_line(sep):
    rnd, quotes = random.Random(1), Quotes(sep)
    for _ in range(4000):
        line = "".join(rnd.choice(f'a"{sep}" ') for _ in range(rnd.randint(0, 14)))
        assert quotes.inside(line.encode(), False) == ends_inside(line, sep), line
        assert quotes.inside(line.encode(), True) == ends_inside('"' + line, sep), line


def messy(seed, rows):
    rnd = random.Random(seed)
    cells = ["Pump", "line one\nline two", 'say "hi"', "a,b", "", "x\n\n\ny", '"', "\n", "Größe é", "plain text of some length"]
    return [[str(i), rnd.choice(cells), rnd.choice(cells), rnd.choice(cells)] for i in range(rows)]


def written(rows, encoding="utf-8", end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["Id", "A", "B", "C"], *rows])
    return out.getvalue().encode(encoding)


def read(spark, path):
    rows = catalog.read_catalog(spark, str(path), "csv").orderBy("row_idx").collect()
    assert [r["row_idx"] for r in rows] == list(range(len(rows)))
    return [[r["Id"], r["A"], r["B"], r["C"]] for r in rows]


def stripped(rows):
    return [[c.strip() for c in r] for r in rows]


def test_line_breaks_over_many_splits(spark, tmp_path):
    rows = messy(2, 3000)
    (tmp_path / "a.csv").write_bytes(written(rows[:2500]))
    (tmp_path / "b.csv").write_bytes(written(rows[2500:], end="\r\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 15
        assert read(spark, tmp_path) == stripped(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_inch_marks_open_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Id,A,B,C\n1,Pipe 5" wide,x,"7"" x 2"""\n\n2,"a\n\nb",3" x 2",z\n')
    assert read(spark, tmp_path) == [["1", 'Pipe 5" wide', "x", '7" x 2"'], ["2", "a\n\nb", '3" x 2"', "z"]]


def test_each_file_has_its_own_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(written([["1", "café", "", ""]]))
    (tmp_path / "b.csv").write_bytes(written([["2", "Köln", "", ""]], "latin-1"))
    (tmp_path / "c.csv").write_bytes(written([["3", "naïve ☃", "", ""]]))
    assert [r[1] for r in read(spark, tmp_path)] == ["café", "Köln", "naïve ☃"]

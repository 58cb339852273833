"""Records with line breaks from files read in splits, against Python's csv
module and Spark's own whole-file reader."""

import csv
import io
import random

import numpy as np
import pytest

from strata.sources import csv_records as CR
from strata.sources import io as IO


def _rows(n, seed):
    rng = random.Random(seed)
    bits = ["a", "b c", ",", "\n", '"', '""', "\n\n", "x,\ny", "é", " ", '",', "\n\"", ",\"\n"]
    return [[f"{seed}-{i}", *["".join(rng.choice(bits) for _ in range(rng.randrange(7))) for _ in range(3)]] for i in range(n)]


def _write(folder, name, rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", "first", "second", "third"])
    w.writerows(rows)
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(out.getvalue().encode())


def _split_bytes(spark, n):
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, str(n))


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    _split_bytes(spark, 700)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_splits(spark, tmp_path, small_splits, end, monkeypatch):
    folder = tmp_path / "cohort.csv"
    one, two = _rows(600, 1), _rows(5, 2)
    one[77][2] = "long\n" * 900           # a record over several splits
    one[78][1] = '\n"\n' * 300
    _write(folder, "one.csv", one, end)
    _write(folder, "two.csv", two, end)
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
    want = [[x or None for x in r] for r in one + two]      # an empty cell without quotes
    for few in (CR.FEW_SPLITS, 0):        # splits sent to all tasks, and joined
        monkeypatch.setattr(CR, "FEW_SPLITS", few)
        got = IO.read_cohort(spark, str(folder), typed=False, multi_line=True)
        assert got.columns == ["id", "first", "second", "third"]
        assert {r[0]: tuple(r) for r in got.collect()} == {r[0]: tuple(r) for r in want}


def test_as_spark_reads_a_whole_file(spark, tmp_path):
    """Quotes within cells that have none around them, missing and additional
    cells, empty lines, no line feed at the end."""
    path = tmp_path / "odd.csv"
    path.write_text('a,b,c\n1,5" pipe,x\n2,"two\nlines",y\n\n3,"",\n4,only\n5,p"q"r,"s ""t"" \n u"\n6,"x","y","z"\n7, "k",end')
    got = IO.read_cohort(spark, str(path), typed=False, multi_line=True).collect()
    plain = (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
             .option("nullValue", "\u0000").option("emptyValue", "").csv(str(path))).collect()
    assert {r[0]: r for r in got} == {r[0]: r for r in plain} and len(got) == len(plain) == 7
    assert IO.read_cohort(spark, str(path), multi_line=True).schema["a"].dataType.simpleString() == "bigint"
    (tmp_path / "none.csv").write_text("a,b\n")
    empty = IO.read_cohort(spark, str(tmp_path / "none.csv"), multi_line=True)
    assert empty.columns == ["a", "b"] and empty.count() == 0


def test_states_by_plain_walk():
    rng = np.random.default_rng(5)
    for _ in range(50):
        out, within = rng.random((2, 40)) < 0.4
        for start in (0, 1):
            state, want = bool(start), []
            for a, b in zip(out, within):
                state = bool(b if state else a)
                want.append(state)
            assert CR._after(out, within, start).tolist() == want

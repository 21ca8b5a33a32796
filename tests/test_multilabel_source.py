"""The data source of multi-label text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from neargrain.sources import multilabel

ROWS = [([1, 2], [10, 11], [1, 2]), ([3], [], []), ([4, 4], [7], [9]), ([5], None, None)]


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(multilabel.MultilabelSource)


def rows(spark, values=ROWS):
    return spark.createDataFrame(values, "labels array<int>, words array<bigint>, counts array<bigint>")


def read(spark, folder, **options):
    return [tuple(r)[1:] for r in spark.read.format("multilabel").options(**options).load(str(folder)).orderBy("doc_id").collect()]


def test_written_lines_come_back(spark, tmp_path):
    folder = tmp_path / "out"
    rows(spark).coalesce(1).write.format("multilabel").mode("append").save(str(folder))
    expected = [(a, b or [], c or []) for a, b, c in ROWS]
    assert read(spark, folder) == expected
    assert read(spark, f"file://{folder}", columns="labels") == [(a,) for a, *_ in ROWS]
    rows(spark, ROWS[:1]).write.format("multilabel").mode("append").save(str(folder))
    assert len(read(spark, folder)) == 5
    rows(spark, ROWS[:1]).write.format("multilabel").mode("overwrite").save(str(folder))
    assert read(spark, folder) == expected[:1]


def test_every_line_is_in_one_range(spark, tmp_path):
    text = "".join(f"{i}, {i + 1} {i}:1 {'9:1 ' * (i % 5)}\n" for i in range(200)) + "\n  \n7 x:1 3:y 5:6 5:7"
    (tmp_path / "a").write_text(text)
    (tmp_path / "b").write_text("8")
    (tmp_path / "_part-hidden").write_text("99\n")
    whole = read(spark, tmp_path)
    assert len(whole) == 202 and whole[-2:] == [([7], [5], [7]), ([8], [], [])]
    for size in (1, 2, 7, 64, 1000):
        assert read(spark, tmp_path, rangeBytes=size if size > 2 else 50 * size) == whole
    ids = [r["doc_id"] for r in spark.read.format("multilabel").option("rangeBytes", 100).load(str(tmp_path)).collect()]
    assert len(set(ids)) == 202


def test_ranges_of_bytes():
    import pyarrow.fs as fs
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(b"ab\nc\n\ndef")
        f.flush()
        for size in range(1, 12):
            parts = [multilabel.Range(0, f.name, a, min(a + size, 9)) for a in range(0, 9, size)]
            assert [x for p in parts for x in multilabel.lines_of(fs.LocalFileSystem(), p)] == [(0, b"ab\n"), (3, b"c\n"), (5, b"\n"), (6, b"def")]


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    folder = tmp_path / "out"
    bad = spark.range(0, 1000, 1, 4).select(F.array(F.assert_true(F.col("id") < 900).cast("int")).alias("labels"), F.array("id").alias("words"), F.array("id").alias("counts"))
    with pytest.raises(Exception):
        bad.write.format("multilabel").mode("append").save(str(folder))
    assert not [p for p in folder.glob("*") if not p.name.startswith("_")]
    assert read(spark, folder) == []

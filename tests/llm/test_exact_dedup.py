import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import deduplicate

ROWS = [(1, "Same"), (2, "sAME"), (3, "Éa"), (4, "éa"), (5, None), (6, ""), (6, ""), (None, "same"), (None, None), (8, "x" * 200_000), (9, "X" * 200_000), (10, "alone ")]


def check(got):
    had = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in got.select("doc_id", "keep_id", "group_size", "kept").collect())
    assert [x[:3] for x in had] == sorted(
        [("1", 2, 3), ("2", 2, 3), ("3", 3, 1), ("4", 4, 1), ("5", 6, 4), ("6", 6, 4), ("6", 6, 4), ("None", 2, 3), ("None", 6, 4), ("8", 9, 2), ("9", 9, 2), ("10", 10, 1)]
    )
    assert sorted(x[0] for x in had if x[3]) == sorted(["2", "3", "4", "6", "9", "10"])


def test_groups_and_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in ROWS], "doc_id long, text string, group_size int, digest string")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    got = deduplicate(spark, str(tmp_path / "t"))
    assert got.columns == ["doc_id", "text", "digest", "keep_id", "group_size", "kept", "text_sha256", "keep_file", "keep_row"]
    check(got)
    df.limit(0).write.parquet(str(tmp_path / "e"))
    assert deduplicate(spark, str(tmp_path / "e")).count() == 0


def test_clashing_digests_are_told_apart(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    check(deduplicate(spark, str(tmp_path / "t"), digest=lambda t: F.length(t) % 2))


def test_later_files_join_the_state(spark, tmp_path):
    path, state = str(tmp_path / "t"), str(tmp_path / "s")
    for part in (ROWS[:5], ROWS[5:]):
        spark.createDataFrame(part, "doc_id long, text string").write.mode("append").parquet(path)
        got = deduplicate(spark, path, state_path=state)
    check(got)


def test_later_files_of_any_age_join_the_state(spark, tmp_path):
    path, state = str(tmp_path / "t"), str(tmp_path / "s")
    for part, days in ((ROWS[:5], 0), (ROWS[5:8], 30), (ROWS[8:], 15_000)):
        before = set(tmp_path.glob("t/*.parquet"))
        spark.createDataFrame(part, "doc_id long, text string").write.mode("append").parquet(path)
        for f in set(tmp_path.glob("t/*.parquet")) - before:
            os.utime(f, (time.time() - days * 86_400,) * 2)
        got = deduplicate(spark, path, state_path=state)
    check(got)


def test_state_of_other_rows_raises(spark, tmp_path):
    path, state = str(tmp_path / "t"), str(tmp_path / "s")
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(path)
    deduplicate(spark, path, state_path=state)
    spark.createDataFrame(ROWS[:3], "doc_id long, text string").write.mode("overwrite").parquet(path)
    with pytest.raises(RuntimeError, match="counts 15 rows"):
        deduplicate(spark, path, state_path=state)

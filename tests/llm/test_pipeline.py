import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tidemark.llm import quality_rules
from tests_llm_brute import line_brute, near_brute


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = [r.doc_id for r in cp.language_id(spark, docs, sf_dir).collect()]
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    assert len(clean & set(kept)) >= 0.98 * len(clean)

    after = cp.quality(spark, docs, sf_dir)
    assert after.columns == columns
    after = cp.materialise(after, "t")
    assert after.count() < docs.count()

    rows = {r.doc_id: r for r in cp.lines(spark, after, sf_dir).collect()}
    want = line_brute([(r.doc_id, r.text) for r in after.collect()])
    assert {k: r.text for k, r in rows.items()} == want and all(r.n_chars == len(r.text) for r in rows.values())

    left = [r.doc_id for r in cp.near_duplicates(spark, after, sf_dir).collect()]
    assert sorted(left) == sorted({c for c in near_brute([(r.doc_id, r.text) for r in after.collect()])})


def test_run(spark, sf_dir):
    """End to end: which documents are left, and every piece of every one of them."""
    out = cp.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = cp.materialise(cp.language_id(spark, docs, sf_dir), "t")
    rules = quality_rules.learn(quality_rules.labelled_statistics(some, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    some = [(r.doc_id, r.text) for r in quality_rules.apply_rules(some, rules).where("kept").collect()]
    some = line_brute(some)
    left = near_brute(list(some.items()))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i in left:
        ids = [*tok.encode(some[i], add_special_tokens=False).ids, 1]
        want += [(i, k, at, min(4096, len(ids) - at), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    by = Counter()
    for r in out:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 4096


def test_stages_take_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows, clashing columns and no rows."""
    text = "the quick brown fox jumps over the lazy dog while seven wise owls read long books about rivers and far mountains in spring"
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, text.upper()), (5, "x" * 300_000), (6, "123 ..."), (7, text + " and then some more words follow here")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rule string, _row1 int, score double"
    df = spark.createDataFrame([(i, t, "en" if t else None, None, None if t is None else len(t), "r", 1, None) for i, t in rows], schema)
    spark.createDataFrame([(3, 1, 0), (None, 0, 0), (99, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, df, str(tmp_path))
        assert got.columns == df.columns and 0 < got.count() <= len(rows)
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert {r.doc_id for r in cp.language_id(spark, df, str(tmp_path)).collect()} == {None, 3, 4, 5, 7}
    assert sorted(str(r.doc_id) for r in cp.quality(spark, df, str(tmp_path)).collect()) == ["3", "3", "4", "7", "None"]
    assert sorted(str(r.doc_id) for r in cp.near_duplicates(spark, df, str(tmp_path)).collect()) == ["1", "2", "3", "5", "6", "7"]
    assert cp.lines(spark, df, str(tmp_path)).count() == len(rows)
    assert cp.pack(spark, df.drop("rule"), str(tmp_path)).count() >= len(rows) and cp.pack(spark, df.limit(0), str(tmp_path)).count() == 0

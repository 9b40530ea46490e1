import hashlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, "  \n\n x\t   y  "), (4, "It's we'll 12 ½ <|endoftext|>!! a<|endoftext|>"), (5, "ab " * 70_000), (5, "ab " * 70_000), (None, "日本 😀 é\x1c z"), (6, "\r\n\r\n a b")]


def want(text, tok):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("max_words", [0, 500, 300_000])
def test_matches_the_library(spark, sf_dir, max_words):
    tok = Tokenizer.from_file(PATH)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD
    df = spark.createDataFrame([(i, t, b"x", 1) for i, t in docs], "doc_id long, text string, IDS binary, _ids int")
    got = bpe.digests(df, PATH, max_words=max_words).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((str(i), *want(t, tok)) for i, t in docs)


def test_words_by_ranks_are_the_librarys():
    """Each distinct word of the documents, and each piece of the vocabulary that is text."""
    enc = bpe.WordEncoder(PATH)
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])
    words = {w for t in table["text"].to_pylist() for w in enc.words(t or "")}
    words |= {x.decode() for x in bpe.pieces(PATH) if x and x.decode("utf-8", "ignore").encode() == x}
    words = sorted(w for w in words if len(enc.find(w)) == 1)
    assert enc.one and [enc.ids(w) for w in words] == [e.ids for e in enc.tok.encode_batch_fast(words, add_special_tokens=False)]


def test_splits_agree():
    enc = bpe.WordEncoder(PATH)
    for t in ("It's  a\ttest\n\n x ", "ÀÖ×÷ß ÿ ŋ ½ a_b 12ab", "\x1c a\x85b\u00a0 c", " \n \n", "don't we'll I'M", "\r\n\x0b\x0c  z"):
        assert enc.words(t) == enc.find(t)


def test_general_interface(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, _ids int")
    got = bpe.decode(bpe.encode(df, PATH), PATH)
    assert got.columns == ["doc_id", "text", "_ids", "ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in got.collect())
    assert bpe.digests(df.limit(0), PATH).count() == 0

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import ChunkEncoder, Plan, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "It's a Test, é  x\x1cy <|endoftext|> 12!"), (5, "word " * 9000), (5, "word " * 9000), (None, "ça va ß İ"), (8, "日本語 " * 700), (9, "Ünd, A<|ENDOFTEXT|> <|endoftext|>, É. E\u0301, don't', »., a=\u0338 b")]


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plan_places_every_rank():
    rng = random.Random(3)
    for trial in range(30):
        top = rng.choice([60, 100])
        counts = Counter(rng.choice([rng.randint(1, top), top // 2 + 1, top, rng.randint(1, 8)]) for _ in range(rng.randint(1, 900)))
        rows = []
        for length, lo, hi, base, fill, each in Plan(counts, top, groups=5).rows:
            rows += [(base + (r - lo) // each, fill + (r - lo) % each * length, length, r) for r in range(lo, hi)]
        assert Counter(r[2] for r in rows) == counts
        assert all(sorted(r[3] for r in rows if r[2] == k) == list(range(n)) for k, n in counts.items())
        n = check_places([r[:3] for r in rows], top)
        assert n <= 1.15 * -(-sum(k * m for k, m in counts.items()) // top) + sum(m for k, m in counts.items() if k > top // 2) * 0.6 + 6


def test_another_kind_of_tokenizer_is_refused():
    with pytest.raises(ValueError, match="word by word"):
        ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_by_ranks_are_the_librarys(sf_dir):
    """Each distinct word of the documents, and each piece of the vocabulary."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])
    words = sorted({w for t in table["text"].to_pylist() for w in (t or "").split()} | {k.removesuffix("</w>") for k in Tokenizer.from_file(PATH).get_vocab()})
    tok, own = Tokenizer.from_file(PATH), ChunkEncoder(PATH)
    want = [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)]
    assert [np.frombuffer(own.ids(w), "<u4").tolist() for w in words] == want


def expected(rows):
    tok, out = Tokenizer.from_file(PATH), []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            out.append((str(i), k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def test_pieces_and_odd_rows(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD
    df = spark.createDataFrame([(i, t, 1, 2, "n") for i, t in docs], "doc_id long, text string, _parts int, length int, piece string")
    got = pack_documents(df, PATH).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected(docs)
    n = check_places([(r.sequence_id, r.offset, r.length) for r in got], 4096)
    assert n <= 1.03 * -(-sum(r.length for r in got) // 4096) + 1
    assert pack_documents(df.limit(0), PATH).count() == 0

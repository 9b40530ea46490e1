"""BPE encoding and decoding with a table of distinct words.

Spark splits texts into the words that the tokenizer never merges across and counts them.
Each distinct word of the table is encoded once, its ids are joined with their pieces, and
both come back to each of its positions.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialise
from .ranks import byte_letters, piece_encoder

#: Fixed value: the published splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII and Latin letters only, as Python's own expressions have no classes of letters.
_LATIN = "À-ÖØ-öø-ɏ"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{_LATIN}]+| ?[0-9]+| ?[^\t-\r A-Za-z{_LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
_OTHER = re.compile(rf"[^\x00-\x7f{_LATIN}]").search
#: Rare words that a worker remembers at most before it forgets them.
REMEMBERED = 200_000


class WordEncoder:
    """Splits texts and encodes words, all by the library's file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.one = piece_encoder(path)
        added = [x["content"] for x in json.loads(self.tok.to_str())["added_tokens"]]
        special = "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile(f"({special})").split if special else None
        self.added = set(added)

    def words(self, text: str) -> list[str]:
        """The text in words; their ids one after another are the text's."""
        find = self.find if _OTHER(text) else _SPLIT
        if any(x in text for x in self.added):
            out = []
            for part in self.special(text):
                out += [part] if part in self.added else find(part)
            return out
        return find(text)

    def ids(self, word: str) -> list[int]:
        """The ids of one word."""
        if self.one and word not in self.added:
            return self.one(word.encode("utf-8", "replace"))
        return self.tok.encode(word, add_special_tokens=False).ids


class Known(dict):
    """What is known of words: the table's, and up to ``REMEMBERED`` others, made when asked for."""

    def __init__(self, table: dict, make):
        super().__init__(table)
        self.table, self.make, self.most = table, make, len(table) + REMEMBERED

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
            self.update(self.table)
        got = self[key] = self.make(key)
        return got


def pieces(path: str) -> list[bytes]:
    """The bytes of each id, special tokens too: a table as large as the vocabulary."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    of, vocab = byte_letters(), said["model"]["vocab"]
    out = [b""] * (max([*vocab.values(), *(x["id"] for x in said["added_tokens"])]) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(of[c] for c in piece)
    for x in said["added_tokens"]:
        out[x["id"]] = x["content"].encode()
    return out


def split(text: Column) -> Column:
    """The words of a text, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def word_table(docs: DataFrame, path: str, *, text_col: str = "text", max_words: int = 300_000) -> DataFrame:
    """(word, ids, piece): the ``max_words`` most frequent distinct words of all texts at most,
    each encoded once to little-endian unsigned 32-bit ids, and the bytes these ids decode to.

    Words are counted over all documents, in each task before the shuffle. The least count
    that keeps the table within ``max_words`` comes from the histogram of counts, so words of one count are
    all in or all out. Decoding joins each id with its piece; the table of pieces is as
    large as the vocabulary.
    """
    spark = docs.sparkSession

    def encode(batches):
        encoder = WordEncoder(path)
        for batch in batches:
            ids = [encoder.ids(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"word": batch.column(0), "ids": pa.array(map(_packed, ids), pa.binary()), "each": pa.array(ids, pa.list_(pa.int32()))})

    words = docs.select(F.explode(split(F.col(f"`{text_col}`"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = materialise(words.where("n > 1"), "words")
    # Counts are few and large where words are many: their histogram is folded to powers of two first.
    power = F.floor(F.log2("n"))
    total, keep = 0, None
    for r in sorted(words.groupBy(power.alias("p")).count().collect(), key=lambda r: -r.p):
        if total + r["count"] > max_words:
            at = words.where(power == r.p).groupBy("n").count().orderBy(F.desc("n")).limit(max_words)
            for x in at.toLocalIterator():
                if total + x["count"] > max_words:
                    break
                total, keep = total + x["count"], x.n
            break
        total, keep = total + r["count"], 2**r.p
    table = words.where(F.col("n") >= keep) if keep is not None else words.limit(0)
    table = materialise(table.select("word").mapInArrow(encode, "word string, ids binary, each array<int>"), "word-ids")
    known = spark.createDataFrame(pa.table({"id": pa.array(range(len(said := pieces(path))), pa.int32()), "piece": pa.array(said, pa.binary())}))
    at = table.select("word", "ids", F.posexplode("each").alias("at", "id")).join(F.broadcast(known), "id")
    joined = at.groupBy("word").agg(F.first("ids").alias("ids"), F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("piece")))).alias("x"))
    return materialise(joined.select("word", "ids", F.unhex(F.array_join("x.piece", "")).alias("piece")), "word-pieces")


def _shared(docs: DataFrame, path: str, text_col: str, max_words: int):
    """The word table as a broadcast dictionary, word -> (packed ids, bytes they decode to)."""
    got = word_table(docs, path, text_col=text_col, max_words=max_words).toArrow()
    words, ids, said = (got.column(c).to_pylist() for c in ("word", "ids", "piece"))
    return docs.sparkSession.sparkContext.broadcast(dict(zip(words, zip(ids, said, strict=True), strict=True)))


def _packed(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _decimal(ids) -> bytes:
    return b",".join([b"%d" % i for i in ids])


def encode(docs: DataFrame, path: str, *, text_col: str = "text", max_words: int = 300_000) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) of each whole text as
    the tokenizers library gives them without special tokens added; a column of this name is
    replaced. Null counts as empty: no ids.

    The table of distinct words is broadcast, ``max_words`` rows at most. Ids are put at
    the positions of its words; a word outside the table, too rare for it, is encoded
    where it stands. The text itself isn't shuffled. Rows are encoded one by one; an empty
    table gives an empty table.
    """
    base = docs.drop(*[c for c in docs.columns if c.lower() == "ids"])
    shared = _shared(base, path, text_col, max_words)
    out = fresh("_ids", base)

    def run(batches):
        encoder = WordEncoder(path)
        known = Known({w: ids for w, (ids, _) in shared.value.items()}, lambda w: _packed(encoder.ids(w)))
        for batch in batches:
            ids = [b"".join(map(known.__getitem__, encoder.words(x.as_py() or ""))) for x in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, out])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out, T.BinaryType())])).withColumnRenamed(out, "ids")


def decode(docs: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with ``text_col``: the bytes of the pieces of ``ids_col`` joined, read as
    UTF-8, what isn't UTF-8 as replacement characters. Null ids give null. A column of this
    name is replaced. Pieces are looked up in a table as large as the vocabulary."""
    base = docs.drop(*[c for c in docs.columns if c.lower() == text_col.lower()])

    def run(batches):
        table = pieces(path)
        for batch in batches:
            texts = [None if x is None else _text(x, table) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(text_col, T.StringType())]))


def _text(ids: bytes, table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", max_words: int = 300_000) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256`` (of the decoded text): what ``encode`` and ``decode`` give, text by
    text in one Python worker, which never holds the ids of more than one text.

    Ids stand in decimal, one string for each distinct word, and the bytes that these ids decode
    to are kept for each such string. Null and empty texts have no ids; null ids of rows and repeated
    rows are kept; other columns aren't read; an empty table gives an empty table.
    """
    some = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    shared = _shared(some, path, text_col, max_words)

    def run(batches):
        encoder, table = WordEncoder(path), pieces(path)
        plain = {w: (_decimal(np.frombuffer(ids, "<u4").tolist()), x) for w, (ids, x) in shared.value.items()}
        decimal = Known({w: d for w, (d, _) in plain.items()}, lambda w: _decimal(encoder.ids(w)))
        piece = Known(dict(plain.values()), lambda d: b"".join([table[int(i)] for i in d.split(b",")]))
        for batch in batches:
            n, first, second = [], [], []
            for text in batch.column(1):
                got = list(map(decimal.__getitem__, encoder.words(text.as_py() or "")))
                ids = b",".join(got)
                n.append(ids.count(b",") + 1 if got else 0)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(b"".join(map(piece.__getitem__, got)).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return some.mapInArrow(run, schema)

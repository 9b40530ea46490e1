"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per language and bucket come from a bounded sample of labelled documents. The
matrix of log probabilities is broadcast and batches are scored sparsely in numpy, with
one gather for each n-gram and a sum for each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: Texts are scored in pieces of so many code points, which bounds memory.
PIECE = 1 << 19
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    points = np.arange(0x110000, dtype=np.uint32)
    return np.where([chr(i).isalpha() for i in range(0x110000)], points, 32).astype(np.uint32)


def _points(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def _buckets(points: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n of 1 to 3: n, the bucket of the n-gram at each place but the last two, and whether it has a letter."""
    m = len(points) - 2
    h, has = np.zeros(m, np.uint32), np.zeros(m, bool)
    for n in range(1, 4):
        h = (h + points[n - 1 : n - 1 + m]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        has = has | (points[n - 1 : n - 1 + m] != 32)
        yield n, (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits), has


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of pieces of texts: code points, the start of each piece, its text's number, and the places before texts.

    Two spaces before each text are its own, and two follow a group, so that each n-gram with
    a letter starts in the piece of one text. A long text is cut at the end of a group; the two
    places after the cut follow that group in place of spaces, and start the next one.
    """
    points, starts, owner, before, size = [], [], [], [], 0
    gap = np.full(2, 32, np.uint32)
    for i, text in enumerate(texts):
        if not text:
            continue
        whole = np.concatenate([gap, _points(text), gap])
        for at in range(0, len(whole) - 2, PIECE):
            part = whole[at : min(at + PIECE, len(whole) - 2)]
            starts.append(size)
            before += [] if at else [size, size + 1]
            owner.append(i)
            points.append(part)
            size += len(part)
            if size >= PIECE:
                yield np.concatenate([*points, whole[at + len(part) :][:2]]), np.array(starts), np.array(owner), np.array(before, np.int64)
                points, starts, owner, before, size = [], [], [], [], 0
    if points:
        yield np.concatenate([*points, gap]), np.array(starts), np.array(owner), np.array(before, np.int64)


@dataclass(frozen=True)
class Model:
    """Languages, log priors, and log probabilities of each bucket (buckets x languages).

    Without ``leads`` the n-grams that start in the spaces before a text score for no text.
    """

    langs: tuple[str, ...]
    prior: np.ndarray
    table: np.ndarray
    bits: int
    leads: bool = False

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        k = len(self.langs)
        sums, letters = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        for points, starts, owner, before in _pieces(texts):
            np.add.at(letters, owner, np.add.reduceat((points[:-2] != 32).astype(np.int64), starts))
            for _, buckets, has in _buckets(points, self.bits):
                if not self.leads:
                    has[before] = False
                at = np.flatnonzero(has)
                if k and len(at):
                    rows = self.table[buckets[at]]
                    where = np.searchsorted(at, starts)
                    where = np.append(where, len(at))
                    total = np.vstack([np.zeros((1, k)), np.cumsum(rows, axis=0, dtype=np.float64)])
                    np.add.at(sums, owner, total[where[1:]] - total[where[:-1]])
        if not k:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        sums += self.prior
        best = sums.argmax(axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if n else UNDETERMINED for b, n in zip(best, letters, strict=True)], np.where(letters > 0, share, 0.0)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = 16, max_documents: int = 20_000, max_langs: int = 500, smoothing: float = 0.5) -> Model:
    """Fit on the ``max_documents`` labelled documents of least id hash.

    Rows without id, text or label are left out. What comes to the driver is one count for
    each language and bucket met, ``max_langs`` times ``2**bits`` at most; more languages
    raise. No labelled row gives a model that finds every text undetermined.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).dropna()
    picked = named.select("d", "lang").orderBy(F.xxhash64("d"), "d", "lang").limit(max_documents).distinct()
    some = named.join(F.broadcast(picked), ["d", "lang"]).select("lang", "text")

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            texts = batch.column("text").to_pylist()
            for lang in np.unique(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                got = np.zeros(1 << bits, np.int64)
                for points, *_ in _pieces(own):
                    for _, buckets, has in _buckets(points, bits):
                        got += np.bincount(buckets[has], minlength=1 << bits)
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": got[at], "docs": np.where(at == at[:1], len(own), 0).astype(np.int64)})

    sums = some.mapInArrow(count, "lang string, bucket int, n long, docs long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    got = sums.collect()
    langs = tuple(sorted({r.lang for r in got}))
    if len(langs) > max_langs:
        raise ValueError(f"{len(langs)} languages; at most {max_langs} are allowed")
    place = {x: i for i, x in enumerate(langs)}
    counts, docs_of = np.full((1 << bits, len(langs)), smoothing), np.zeros(len(langs))
    for r in got:
        counts[r.bucket, place[r.lang]] += r.n
        docs_of[place[r.lang]] += r.docs
    table = np.log(counts / counts.sum(axis=0)).astype(np.float32) if langs else np.zeros((1 << bits, 0), np.float32)
    return Model(langs, np.log((docs_of + 1) / (docs_of + 1).sum()), table, bits, leads=True)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    ``score`` is the posterior probability, 0 to 1. A null or empty text, and one without a
    letter, is ``und`` with score 0. Whole texts are read. Rows are scored one by one; an
    empty table gives an empty table.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    pred, score = fresh("_pred", docs), fresh("_score", docs)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, pred, score])

    return docs.mapInArrow(run, schema).withColumnsRenamed({pred: "lang_pred", score: "score"})

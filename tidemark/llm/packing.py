"""Best-fit packing of token sequences, planned over the histogram of lengths.

Large lengths are rounded up within groups of equal cardinality (linear grouping). A linear
programme over configurations of these few sizes, solved by column generation, says how
often each configuration is used. Actual documents take the places of their group, and the
small ones go best-fit into what is left. The plan depends only on the count of each
length, so it fits the driver at any number of documents; documents find their place by
their rank within their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from functools import cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .ranks import piece_encoder

#: Words that a worker remembers at most before it forgets all of them.
REMEMBERED = 400_000
#: Fixed value: the published splitting pattern of the tokenizer, for words of ``_PLAIN``.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Words of printing ASCII and Latin letters: no form of theirs is composed anew.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: What the file must say for ids to be put together here.
_SAID = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", ["NFC", "Replace", "Lowercase"])


class ChunkEncoder(dict):
    """Ids of whole texts under a tokenizer that lower-cases, drops white space and never
    joins over it: a dictionary that encodes a word of the text when first asked for it.

    A text is cut at ASCII white space; what stands between is encoded once and remembered:
    equal to encoding the text at once. A-Z are lower-cased first, as the tokenizer does
    anyway. Words outside ``_PLAIN`` or with a special token in them go to the library.
    A file whose normaliser or splitting is another raises ValueError.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split = (said["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        norm = (said["normalizer"] or {}).get("normalizers") or []
        if (split[0].get("pattern", {}).get("Regex"), [x["type"] for x in norm]) != _SAID:
            raise ValueError(f"texts can't be encoded word by word under {path}")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        special = [x.content.encode() for x in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special)) or b"(?!)").search
        self.lowered = [x.lower() for x in special]
        self.one = piece_encoder(path)

    def __missing__(self, word: bytes) -> bytes:
        if self.one and word.isalpha():  # ASCII letters: one piece
            ids = self.one(word.lower())
        elif self.one and _PLAIN.fullmatch(text := word.decode()) and not self.special(word):
            ids = [i for piece in _SPLIT.findall(text.lower()) for i in self.one(piece.encode())]
        else:
            ids = self.tok.encode(word.decode(), add_special_tokens=False).ids
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[word] = array("I", ids).tobytes()
        return got

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        raw = (text or "").encode("utf-8", "replace")
        low = raw.lower()
        # A special token's own text must reach the tokenizer as it is.
        words = raw.split() if any(x in low for x in self.lowered) else low.split()
        return b"".join(map(self.__getitem__, words))


@cache
def encoder_of(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a Python worker, so that what it remembers lasts."""
    return ChunkEncoder(path)


def cut(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(id, piece, start, length, ids_crc32, salt) of each document's ids and ``end_id``
    after them, cut at ``capacity``. Null text counts as empty: one piece of ``end_id``."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, salt int"
    end = int(end_id).to_bytes(4, "little")
    arrow = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int32())])

    def run(batches):
        encoder, row = encoder_of(tokenizer_path), 0
        for batch in batches:
            owner, out = [], []
            for i, text in enumerate(batch.column(1)):
                ids = encoder.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    owner.append(i)
                    out.append((k, at // 4, len(part) // 4, zlib.crc32(part), row % (1 << 20)))
                    row += 1
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)]], names=[id_col, *arrow.names])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def configurations(sizes: list[int], need: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of configurations (how many of each size) for few sizes.

    Column generation for the linear programme of least bins: prices of the sizes come from
    the present basis, and the configuration that pays best enters it until none pays.
    Sizes are over a fifth of the capacity, so all configurations can be listed. The solution is rounded down; what is left over isn't covered.
    """
    k, most = len(sizes), capacity // min(sizes)
    if most > 4:
        raise ValueError("sizes must be over a fifth of the capacity")
    picks = [c for r in range(1, most + 1) for c in combinations_with_replacement(range(k), r) if sum(sizes[j] for j in c) <= capacity]
    all_ = np.zeros((len(picks), k))
    for i, c in enumerate(picks):
        np.add.at(all_[i], list(c), 1)
    basis = np.diag([float(capacity // s) for s in sizes])
    x = np.linalg.solve(basis, np.array(need, float))
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        worth = all_ @ price
        at = int(worth.argmax())
        if worth[at] <= 1 + 1e-9:
            break
        column = all_[at]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        x = np.maximum(np.linalg.solve(basis, np.array(need, float)), 0)
    got: dict[tuple[int, ...], int] = defaultdict(int)
    for j in range(k):
        got[tuple(int(round(v)) for v in basis[:, j])] += int(x[j] + 1e-6)
    left, out = list(need), []
    for config, n in got.items():
        n = min([n, *(r // c for r, c in zip(left, config, strict=True) if c)])
        if n > 0 and any(config):
            left = [r - c * n for r, c in zip(left, config, strict=True)]
            out.append((config, n))
    return out


class Plan:
    """Places for ranks of each length: ``rows`` of (length, lo, hi, base, fill, each).

    Rank r of [lo, hi) goes to sequence ``base + (r - lo) // each`` at offset
    ``fill + (r - lo) % each * length``.
    """

    def __init__(self, counts: dict[int, int], capacity: int, groups: int = 24, large: float = 0.25):
        self.capacity, self.bins, self.rows = capacity, 0, []
        self.used: dict[int, int] = defaultdict(int)  # ranks given out by length
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (bins, first bin)
        self.rooms: list[int] = []
        left = {k: n for k, n in counts.items() if n}
        big = [(k, n) for k, n in sorted(left.items(), reverse=True) if large * capacity < k < capacity]
        for config, n, queues in self._configured(big, groups):
            self._fill(config, n, queues)
        for k, n in sorted(left.items(), reverse=True):
            self._best_fit(k, n - self.used[k])

    def _place(self, length: int, n: int, base: int, fill: int, each: int) -> None:
        self.rows.append((length, self.used[length], self.used[length] + n, base, fill, each))
        self.used[length] += n

    def _leave(self, room: int, bins: int, base: int) -> None:
        if bins and room:
            if not self.free[room]:
                insort(self.rooms, room)
            self.free[room].append((bins, base))

    def _configured(self, big, groups):
        total, parts, at = sum(n for _, n in big), [], 0
        if not total:
            return
        for length, n in big:  # groups of equal cardinality, largest lengths first
            while n:
                g = at * groups // total
                take = min(n, -(-(g + 1) * total // groups) - at)
                if len(parts) <= g or not parts:
                    parts += [[] for _ in range(g + 1 - len(parts))]
                parts[g].append([length, take])
                at, n = at + take, n - take
        parts = [p for p in parts if p]
        by_size: dict[int, list] = {}
        for p in parts:  # rounded up to the largest of the group; equal sizes are one
            by_size.setdefault(p[0][0], []).extend(p)
        sizes = list(by_size)
        queues = list(by_size.values())
        for config, n in configurations(sizes, [sum(m for _, m in q) for q in queues], self.capacity):
            yield config, n, queues

    def _fill(self, config, n, queues) -> None:
        """Actual lengths of the groups take the places of ``n`` bins of a configuration."""
        slots = [g for g, c in enumerate(config) for _ in range(c)]
        runs = []
        for g in slots:
            run, need = [], n
            while need:
                length, m = queues[g][0]
                take = min(m, need)
                run.append((length, take))
                need -= take
                if take == m:
                    queues[g].pop(0)
                else:
                    queues[g][0][1] -= take
            runs.append(run)
        at = 0
        while at < n:  # stretches of bins in which each slot has one length
            width = min(run[0][1] for run in runs)
            fill = 0
            for i, run in enumerate(runs):
                length, m = run[0]
                self._place(length, width, self.bins, fill, 1)
                fill += length
                runs[i] = ([(length, m - width)] if m > width else []) + run[1:]
            self._leave(self.capacity - fill, width, self.bins)
            self.bins, at = self.bins + width, at + width

    def _best_fit(self, length: int, n: int) -> None:
        while n > 0:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = self.capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    self._place(length, whole * each, self.bins, 0, each)
                    self._leave(self.capacity - each * length, whole, self.bins)
                    self.bins += whole
                if rest:
                    self._place(length, rest, self.bins, 0, each)
                    self._leave(self.capacity - rest * length, 1, self.bins)
                    self.bins += 1
                return
            room = self.rooms[i]
            bins, base = self.free[room].pop()
            if not self.free[room]:
                self.rooms.pop(i)
            each, fill = room // length, self.capacity - room
            whole, rest = min(bins, n // each), 0
            if whole < bins:
                rest = n - whole * each if n - whole * each < each else 0
            took = whole * each + rest
            self._place(length, took, base, fill, each)
            self._leave(room - each * length, whole, base)
            if rest:
                self._leave(room - rest * length, 1, base + whole)
            over = whole + (rest > 0)
            self._leave(room, bins - over, base + over)
            n -= took


def pack(pieces: DataFrame, *, capacity: int = 4096, groups: int = 24, salt_rows: int = 2000) -> DataFrame:
    """``pieces`` (of ``cut``) with ``sequence_id`` and ``offset`` instead of ``salt``.

    Every piece is in one sequence; each sequence is gapless from 0 and holds ``capacity``
    tokens at most. To the driver comes one count for each length, ``capacity`` rows at
    most; broadcast is the plan, of a few rows for each length and configuration. A length that many
    pieces share is ranked in parts of about ``salt_rows`` pieces.
    """
    pieces = materialise(pieces, "pieces")
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(counts, capacity, groups)
    parts = spark.createDataFrame([(int(k), -(-n // salt_rows)) for k, n in counts.items()], "length long, _parts long")
    p = pieces.join(F.broadcast(parts), "length").withColumn("_part", F.pmod(F.col("salt").cast("long"), F.col("_parts"))).drop("_parts")
    sizes = p.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = materialise(sizes.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before")), "ranks")
    own = [c for c in pieces.columns if c != "salt"]
    order = Window.partitionBy("length", "_part").orderBy(*[F.col(f"`{c}`") for c in own if c != "length"], "salt")
    ranked = p.withColumn("_rank", F.row_number().over(order) - 1).join(sizes, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    rows = spark.createDataFrame([tuple(map(int, r)) for r in plan.rows], "length long, _lo long, _hi long, _base long, _fill long, _each long")
    placed = ranked.join(F.broadcast(rows), (ranked["length"] == rows["length"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).drop(rows["length"])
    k = F.col("_rank") - F.col("_lo")
    return placed.select(*[F.col(f"`{c}`") for c in own], (F.col("_base") + F.floor(k / F.col("_each"))).alias("sequence_id"), (F.col("_fill") + F.pmod(k, F.col("_each")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece of each document: id, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id`` and ``offset``.

    Null and empty texts are one piece of ``end_id``; null ids and repeated rows are packed
    like any other; other columns aren't read. An empty table gives an empty table. The id
    column may have any name but those of the result.
    """
    return pack(cut(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), capacity=capacity)


__all__ = ["ChunkEncoder", "Plan", "configurations", "cut", "pack", "pack_documents"]

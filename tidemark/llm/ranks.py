"""Byte-pair encoding of one piece of text at a time, from a tokenizer's own file."""

from __future__ import annotations

import json
from collections.abc import Callable

#: Stands for a word's end in rank tables; no byte of UTF-8 is like it.
END = b"\xff"


def byte_letters() -> dict[str, int]:
    """The letter of each byte in files of byte-level vocabularies: itself where it prints,
    else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)).difference(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(path: str) -> dict[bytes, int]:
    """The id of each piece of the vocabulary; a piece that ends a word ends in ``END``."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of, suffix = byte_letters(), model.get("end_of_word_suffix") or ""
    out = {}
    for piece, i in model["vocab"].items():
        ends = bool(suffix) and piece.endswith(suffix)
        out[bytes(of[c] for c in (piece[: -len(suffix)] if ends else piece)) + (END if ends else b"")] = i
    return out


def piece_encoder(path: str) -> Callable[[bytes], list[int]] | None:
    """Gives the ids of one piece of the splitting pattern, or None where ranks can't say them.

    Merges are applied in the order of their ids, least first. The file says the same when
    each merge makes the next id, from the first id that isn't a single byte; that is
    checked here. A word's end, where the vocabulary marks it, counts as one more byte
    that joins the byte before it first of all.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    first = 512 if suffix else 256
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or odd or [vocab.get(x) for x in joined] != list(range(first, first + len(joined))) or len(vocab) != first + len(joined):
        return None
    ranks = piece_bytes(path)
    if suffix:
        ranks[END] = len(vocab)
    one = tiktoken.Encoding("file", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return (lambda piece: one(piece + END)) if suffix else one

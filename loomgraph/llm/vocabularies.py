"""Public vocabularies as encoders for workers: byte-level BPE from its JSON file, piece BPE from its model file.

The files are read once, where the plan is made; workers get their bytes and keep the encoder from task to task.
"""

from __future__ import annotations

import json

import numpy as np
import tiktoken

from loomgraph.llm.common import KEPT

#: The pre-tokenisation that a byte-level file asks for with use_regex (fixed value of that format).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others by number."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE file's encoder: ids equal those of the `tokenizers` library. With special, the strings of special
    tokens in a text become these tokens; else they are plain text."""

    def __init__(self, data: bytes, special: bool):
        spec = json.loads(data)
        kind, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind.get("use_regex", True) or model["type"] != "BPE":
            raise ValueError("not a plain byte-level BPE file")
        table = byte_of()
        entry = lambda text: bytes(map(table.__getitem__, text))
        ranks = {entry(text): k for text, k in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [ranks[entry(a + b)] for a, b in merges]
        if any(x >= y for x, y in zip(ids, ids[1:])):
            raise ValueError("the file's merges aren't in the order of their ids")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]} if special else {}
        self.entries = {k: e for e, k in ranks.items()} | {k: t.encode() for t, k in self.special.items()}
        self.codec = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=self.special)
        self.size = max(self.entries) + 1

    def ids(self, text: str) -> list[int]:
        if self.special:
            return self.codec.encode(text, allowed_special="all", disallowed_special=())
        return self.codec.encode_ordinary(text)


class Pieces:
    """A piece BPE model's encoder; an entry's bytes are its piece in UTF-8 with U+2581 as space, or the one byte of <0xHH>."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.codec = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.size = self.codec.vocab_size()
        piece = self.codec.id_to_piece
        self.entries = {k: bytes([int(piece(k)[1:-1], 16)]) if self.codec.is_byte(k) else piece(k).replace("▁", " ").encode() for k in range(self.size)}

    def ids(self, text: str) -> list[int]:
        return self.codec.encode(text, num_threads=1)


def lengths(entries: dict[int, bytes], size: int) -> np.ndarray:
    """The number of bytes of each id."""
    out = np.zeros(size, dtype=np.int64)
    for k, e in entries.items():
        out[k] = len(e)
    return out


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def kept(kind: str, make):
    """What make() gives, kept in the worker for tasks of this kind."""
    if kind not in KEPT:
        KEPT[kind] = make()
    return KEPT[kind]

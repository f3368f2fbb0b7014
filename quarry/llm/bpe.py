"""Byte-level BPE encoding and decoding of whole texts over Arrow batches.

The merges run in the ``tokenizers`` library. A rank file holds token bytes
and ranks; every way to cut a token into two tokens becomes a merge, in the
order of the merged token's rank, so a merge of any two neighbours goes by the
rank of what they make. A piece that is itself a token is taken whole.
"""

from __future__ import annotations

import base64
import codecs
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames, textkit


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones stand for themselves, others move past 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, moved = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + moved)
            moved += 1
    return out


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Each cut of each token, by rank; of cuts that can overlap in one text, the one that stands left comes first."""
    out = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        n = len(token)
        cuts = [i for i in range(1, n) if token[:i] in ranks and token[i:] in ranks]
        # Cut i stands left of cut n - i in a text where token[i:] is shared, i.e. token[i:] == token[:n - i].
        first = [i for i in cuts if token[i:] == token[: n - i]]
        for i in sorted(cuts, key=lambda i: (i not in first, i)):
            out.append((token[:i], token[i:]))
    return out


#: One space between characters that are not white space: the split pattern always starts a piece there.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Stands between the parts of a text while it is split.
_MARK = "\0"
#: Pieces in each of the two generations that a worker remembers, about 200 bytes each, and the longest of them.
_MEMORY, _MEMORY_CHARS = 180_000, 48


class ByteTable:
    """Decoder for the tokens of a rank file (lines of base64 bytes and a rank)."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, rank_file.splitlines()))}
        self.chars = byte_characters()
        back = {c: b for b, c in enumerate(self.chars)}
        self.table: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.table[r] = bytes(back[c] for c in self.name(t))
        self.sizes = np.fromiter(map(len, self.table), np.int64, len(self.table))

    def name(self, token: bytes) -> str:
        return "".join([self.chars[b] for b in token])

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode_stream(self, parts) -> list[str]:
        """Text of consecutive id lists; a character split between lists comes with the list that ends it."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        out = [decoder.decode(self.decode_bytes(p)) for p in parts]
        tail = decoder.decode(b"", final=True)
        return out[:-1] + [out[-1] + tail] if out else out


class ByteBPE(ByteTable):
    """Encoder and decoder for the tokens of a rank file."""

    def __init__(self, rank_file: bytes):
        from tokenizers import Tokenizer, models, pre_tokenizers

        super().__init__(rank_file)
        name = {t: self.name(t) for t in self.ranks}
        model = models.BPE(vocab={name[t]: r for t, r in self.ranks.items()}, merges=[(name[a], name[b]) for a, b in _merges(self.ranks)], ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Equal parts of the texts are encoded once; their ids are remembered as packed 32-bit numbers."""
        # A text that holds the mark itself is one part.
        parts = [_BETWEEN.sub(_MARK + " ", t).split(_MARK) if _MARK not in t else [t] for t in texts]
        if len(self.memory) > _MEMORY:
            self.older, self.memory = self.memory, {}
        memory, older = self.memory, self.older
        absent = set(chain.from_iterable(parts)).difference(memory)
        again = absent.intersection(older)
        memory.update(zip(again, map(older.__getitem__, again)))
        new = list(absent - again)
        memory.update(zip(new, (array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        out = [np.frombuffer(b"".join(map(memory.__getitem__, p)), np.int32) for p in parts]
        for x in new:
            if len(x) > _MEMORY_CHARS:
                del memory[x]
        return out

    def starts(self, text: str, ids: np.ndarray) -> np.ndarray:
        """The character in which each token begins; a token that begins within a character has that character."""
        data = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        at = np.cumsum(self.sizes[ids]) - self.sizes[ids] if len(ids) else np.zeros(0, np.int64)
        return char[at]


@lru_cache(maxsize=4)
def _bpe(rank_file: bytes) -> ByteBPE:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBPE(rank_file)


@lru_cache(maxsize=4)
def _table(rank_file: bytes) -> ByteTable:
    return ByteTable(rank_file)


def encode(df: DataFrame, rank_file: bytes, text: str = "text", keep: list[str] | None = None, offsets: bool = False) -> DataFrame:
    """Token ids of each whole text: ``keep`` beside n_tokens, ids and, if asked for, starts (characters).

    One row out for each row in. A null or empty text has no tokens; text that
    looks like a special token is ordinary text. Texts of any length are
    encoded whole, about 1 MB of texts at a time.
    """
    keep = keep or []

    def run(batch: pa.RecordBatch) -> dict:
        bpe, ids, starts = _bpe(rank_file), [], []
        for _, part in textkit.text_slices(batch, text):
            texts = [x.decode() for x in part]
            got = bpe.encode(texts)
            ids += got
            if offsets:
                starts += [bpe.starts(t, x) for t, x in zip(texts, got)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        at = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        made = {"n_tokens": sizes, "ids": pa.ListArray.from_arrays(at, np.concatenate(ids) if ids else np.zeros(0, np.int32))}
        if offsets:
            made["starts"] = pa.ListArray.from_arrays(at, np.concatenate(starts).astype(np.int32) if starts else np.zeros(0, np.int32))
        return made

    return frames.arrow_map(df.select(*dict.fromkeys([*keep, text])), run, keep, "n_tokens long, ids array<int>" + ", starts array<int>" * offsets)


def decode(df: DataFrame, rank_file: bytes, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Bytes of each id list: ``keep`` beside decoded (binary). A null or empty list gives no bytes."""
    keep = keep or []

    def run(batch: pa.RecordBatch) -> dict:
        table, col = _table(rank_file), batch.column(batch.schema.get_field_index(ids))
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        out = []
        for i in range(len(col)):
            x = col[i]
            out.append(table.decode_bytes(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"")
        return {"decoded": pa.array(out, pa.binary())}

    return frames.arrow_map(df.select(*dict.fromkeys([*keep, ids])), run, keep, "decoded binary")

"""Encoding of a corpus with a public byte-level BPE tokenizer.

Method: forced-boundary splitting. Merges only ever build tokens of the vocabulary, so two
neighbouring bytes that stand side by side inside no token mark a certain cut. A text is cut at
such places, the fragments (mostly a word with the blank before it) are encoded independently, and
their ids concatenated. As fragments repeat all over a corpus, each is encoded once per worker.

The tokenizer also splits a text by a regular expression before it merges, and that sees the
neighbours of a place. So a cut is only made where the expression can't tell the difference:
between characters, not after white space (its last character joins what follows) and not
before an apostrophe (it could begin a contraction).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.session import share_code

#: Folder of the public tokenizers' files, on every machine.
TOKENIZERS = "/opt/tokenizers"
#: Fragments a worker remembers before it starts anew; a matter of memory, not of results.
REMEMBERED = 200_000


def _token_bytes(vocab: dict[str, int]) -> list[bytes]:
    """The vocabulary's tokens as bytes: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    at = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}
    return [bytes(at[c] for c in t) for t in vocab if all(c in at for c in t)]


class FragmentEncoder:
    """Encodes many texts; keeps the ids of the fragments it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = json.loads(Path(path).read_text())["model"]["vocab"]
        inside = np.zeros(65536, bool)
        for t in _token_bytes(vocab):
            b = np.frombuffer(t, np.uint8).astype(np.uint16)
            inside[(b[:-1] << 8) | b[1:]] = True
        self.forced = ~inside
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def cuts(self, buf: np.ndarray) -> np.ndarray:
        """Offsets at which `buf` (UTF-8) may be cut."""
        if len(buf) < 2:
            return np.zeros(0, np.int64)
        a, b = buf[:-1], buf[1:]
        ok = self.forced[(a.astype(np.uint16) << 8) | b]
        ok &= (b & 0xC0) != 0x80
        ok &= b != 0x27
        ok &= ~(((a >= 9) & (a <= 13)) | ((a >= 28) & (a <= 32)))
        ok[1:] &= ~((buf[:-2] == 0xC2) & ((a[1:] == 0x85) | (a[1:] == 0xA0)))
        if len(buf) > 3:
            x, y, z = buf[:-3], buf[1:-2], a[2:]
            space = (x == 0xE2) & (y == 0x80) & (((z >= 0x80) & (z <= 0x8A)) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
            space |= ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80)) | ((x == 0xE1) & (y == 0x9A) & (z == 0x80))
            ok[2:] &= ~space
        return np.flatnonzero(ok) + 1

    def _learn(self, fragments: list[bytes]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch([f.decode("utf-8") for f in fragments], add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.starts)
        self.index.update(zip(fragments, range(first, first + len(ids)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(n) - n])
        self.lengths = np.concatenate([self.lengths, n])
        self.pool = np.concatenate([self.pool, np.fromiter((x for e in ids for x in e), np.int32, int(n.sum()))])

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """A list of ids for each text; an empty one for null."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if texts.offset:
            texts = pa.concat_arrays([texts])
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = (texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        lo, hi = (int(ends[0]), int(ends[-1])) if len(ends) else (0, 0)
        buf = np.frombuffer(raw, np.uint8)[lo:hi]
        bounds = np.union1d(self.cuts(buf) + lo, ends)
        fragments = [raw[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        if len(self.index) > REMEMBERED:
            self._forget()
        if new := list({f for f in fragments if f not in self.index}):
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, fragments), np.int64, len(fragments))
        n = self.lengths[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.starts[at] - total[:-1], n) + np.arange(total[-1])]
        offsets = total[np.searchsorted(bounds, ends)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


@lru_cache(maxsize=2)
def _encoder(path: str) -> FragmentEncoder:
    """One encoder per worker process."""
    return FragmentEncoder(path)


def encode_corpus(documents: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; a row for every row of `documents`.

    A null, an empty text gives an empty list; blank text has the ids of its blanks. Strings of
    special tokens are ordinary text. Repeated rows stay repeated, a null key stays null, other columns are
    ignored. `tokenizer` is a byte-level BPE file that every executor can read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, max(b.num_rows, 1), 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), _encoder(tokenizer).encode(part.column(1))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return share_code(documents).select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")

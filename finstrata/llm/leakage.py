"""Evaluation passages inside a training corpus.

Method: size-partitioned MinHash containment search. A short passage in a long document has a
Jaccard similarity near zero with it, so the document is partitioned into overlapping domains of
exactly the size of what is searched for: windows of RUN consecutive words, each a set of five-word shingles.
Against a domain of its own size a contained window has containment and similarity 1, so equal
MinHash values find every one of them: the search has no false negatives at one hash function per
domain. Hits are then verified by exact comparison of their words.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.session import share_code

#: A leak is a run of so many consecutive words.
RUN = 12
#: Words of a shingle.
SHINGLE = 5
#: Items with more windows or bytes than this are joined by shuffle, not sent to every executor. A window takes some 400 bytes in a worker's index.
MAX_SENT_WINDOWS, MAX_SENT_BYTES = 200_000, 16_000_000
#: Words a worker remembers the hash of, before it starts anew.
REMEMBERED = 500_000

_WORD = regex.compile(r"[\p{L}\p{Nd}]+")
_MARKS = regex.compile(r"\p{M}+")


def words(text: str | None) -> list[str]:
    """Runs of letters or digits after compatibility decomposition, removal of combining marks and lower-casing."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """word -> 64-bit hash, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_minima(hashes: np.ndarray, run: int = RUN, shingle: int = SHINGLE) -> np.ndarray:
    """The MinHash of each window of `run` words: the least hash of its shingles. Empty for fewer words."""
    n = len(hashes) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    last = len(hashes) - shingle + 1
    h = np.zeros(last, np.uint64)
    for i in range(shingle):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : last + i]
    h = _mix(h)
    width, size = run - shingle + 1, 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def _hashed(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))


class ItemIndex:
    """MinHash values of all windows of all items, to look documents up in."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN):
        self.run = run
        self.words = [(i, words(t)) for i, t in items]
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(self.words):
            for p, m in enumerate(window_minima(_hashed(w), run).tolist()):
                self.at[m].append((k, p))
        self.values = np.array(sorted(self.at), np.uint64)

    def search(self, tokens: list[list[str]]) -> Iterator[tuple[int, int, int]]:
        """(number of the document, item, windows): for every item that shares a window with a document."""
        flat = [w for t in tokens for w in t]
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        minima = window_minima(_hashed(flat), self.run)
        if not len(minima) or not len(self.values):
            return
        near = np.minimum(np.searchsorted(self.values, minima), len(self.values) - 1)
        hit = (self.values[near] == minima) & (owner[: len(minima)] == owner[self.run - 1 :])
        found: dict[tuple[int, int], int] = defaultdict(int)
        for p in np.flatnonzero(hit).tolist():
            own = flat[p : p + self.run]
            for k in {k for k, q in self.at[int(minima[p])] if self.words[k][1][q : q + self.run] == own}:
                found[int(owner[p]), k] += 1
        for (d, k), n in found.items():
            yield d, self.words[k][0], n


_LEAKS = "doc_id bigint, item_id bigint, windows bigint"


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _sent(documents: DataFrame, items: list[tuple[int, str | None]], run: int) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(items)
    index: list[ItemIndex] = []

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not index:
            index.append(ItemIndex(held.value, run))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = part.column(0).to_pylist()
                hits = [(ids[d], i, n) for d, i, n in index[0].search([words(t) for t in part.column(1).to_pylist()])]
                yield _batch(hits, ["doc_id", "item_id", "windows"], [pa.int64()] * 3)

    return documents.mapInArrow(search, _LEAKS)


def _joined(documents: DataFrame, items: DataFrame, run: int) -> DataFrame:
    """The same over a shuffle by MinHash value, for items of any number."""

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(i, m) for m in np.unique(window_minima(_hashed(words(t)), run)).view(np.int64).tolist()]
            yield _batch(rows, ["id", "m"], [pa.int64(), pa.int64()])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple[int, str] | None, ItemIndex | None] = (None, None)  # rows of an item follow each other
        for b in batches:
            rows = []
            for d, text, i, item in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if held[0] != (i, item):
                    held = ((i, item), ItemIndex([(i, item)], run))
                rows += [(d, i, n) for _, _, n in held[1].search([words(text)])]
            yield _batch(rows, ["doc_id", "item_id", "windows"], [pa.int64()] * 3)

    own = documents.mapInArrow(minima, "id bigint, m bigint").select(F.col("id").alias("doc_id"), "m")
    theirs = items.mapInArrow(minima, "id bigint, m bigint").select(F.col("id").alias("item_id"), "m")
    near = own.join(theirs, "m").select("doc_id", "item_id").distinct()
    texts = near.join(documents, "doc_id").join(items, "item_id").select("doc_id", "text", "item_id", "item")
    return texts.sortWithinPartitions("item_id").mapInArrow(verify, _LEAKS)


def _windows(items: DataFrame, run: int) -> int:
    """How many windows the items have in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(sum(max(0, len(words(t)) - run + 1) for t in b.column(0).to_pylist()),)], ["n"], [pa.int64()])

    return items.select("item").mapInArrow(count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def leaks(documents: DataFrame, eval_items: DataFrame, run: int = RUN, max_sent_bytes: int = MAX_SENT_BYTES, max_sent_windows: int = MAX_SENT_WINDOWS) -> DataFrame:
    """(doc_id, item_id, windows): each document and item that share a run of `run` words, and of how many windows.

    Null, empty and short texts match nothing; rows with a null id are left out; repeated rows give one
    row, copies under another doc_id one each. Items of at most `max_sent_bytes` and `max_sent_windows` in all go to every executor,
    which is checked before; more are joined by shuffle, with the same result.
    """
    docs = share_code(documents).filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = eval_items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("item")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("item") + 64), F.lit(0))).first()[0]
    few = size <= max_sent_bytes and _windows(items, run) <= max_sent_windows
    hits = _sent(docs, [(r[0], r[1]) for r in items.collect()], run) if few else _joined(docs, items, run)
    return hits.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"))

"""Benchmark decontamination by a prefix-filtered set join.

Every item is a set of windows of consecutive words. The words of a window are
ordered by rarity, their number of documents in the whole corpus. As a window
has to occur whole, its necessary prefix is its rarest word alone: a document
that holds the window holds that word. Documents are joined with the windows on
this word; the word's place in the window then bounds where the window would
start and end, and only windows inside the text are compared, word by word.

The benchmark is cut into blocks of bounded size. The driver reads it as a
stream and writes block after block to the shared folder; tasks read the blocks
from there and keep a bounded number of them, so nobody holds the whole.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitweave.llm import textcodes as tc
from bitweave.llm.common import bounded_batches, lean, put_file, read_file, scratch, stored

WINDOW = 8
#: Characters of a block about, and blocks that a task keeps; if there are more, it goes through them for each Arrow batch.
BLOCK_CHARS, KEEP = 1_000_000, 4


def _item_words(text: str | None) -> list[bytes]:
    raw, at = tc.utf8(pa.array([text], pa.string()))
    low, starts, stops, _, _ = tc.words(raw, at)
    return [low[a:b].tobytes() for a, b in zip(starts, stops, strict=True)]


class Windows:
    """The windows of a block of items, and after rank() their index by rarest word."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int) -> None:
        self.size, self.items, found = size, [], {}
        for item, text in items:
            words = _item_words(text)
            if words:
                k = len(self.items)
                self.items.append(item)
                for i in range(max(1, len(words) - size + 1)):
                    found.setdefault(tuple(words[i : i + size]), []).append(k)
        self.words = list(found)
        self.of = [np.unique(x) for x in found.values()]
        self.lens = np.array([len(w) for w in self.words], dtype=np.int64)
        self.codes = np.zeros((len(self.words), size), dtype=np.uint64)
        known = {w: tc.code_of(w) for words in self.words for w in words}
        for i, words in enumerate(self.words):
            self.codes[i, : len(words)] = [known[w] for w in words]
        self.vocab = np.unique(np.fromiter(known.values(), np.uint64, len(known)))

    def rank(self, documents: np.ndarray) -> Windows:
        """Set each window's necessary word; documents: for each word of vocab, how many documents hold it."""
        inside = np.arange(self.size) < self.lens[:, None]
        rare = np.where(inside, documents[np.searchsorted(self.vocab, np.where(inside, self.codes, self.vocab[:1]))], np.iinfo(np.int64).max)
        place = rare.argmin(axis=1)
        word = self.codes[np.arange(len(place)), place]
        order = np.argsort(word, kind="stable")
        self.prefix, self.begin = np.unique(word[order], return_index=True)
        self.count = np.diff([*self.begin, len(order)])
        self.window, self.place = order, place[order]
        return self

    def hits(self, low: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first words, windows) of all occurrences in a chunk of texts."""
        k = np.searchsorted(self.prefix, codes)
        k[k == len(self.prefix)] = 0
        at = np.flatnonzero(self.prefix[k] == codes)
        k = k[at]
        n = self.count[k]
        at, slot = np.repeat(at, n), np.repeat(self.begin[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window, begin = self.window[slot], at - self.place[slot]
        text = np.searchsorted(first, at, side="right") - 1
        keep = (begin >= first[text]) & (begin + self.lens[window] <= first[text + 1])
        begin, window = begin[keep], window[keep]
        for j in range(self.size):
            inside = j < self.lens[window]
            keep = ~inside | (codes[np.where(inside, begin + j, 0)] == self.codes[window, j])
            begin, window = begin[keep], window[keep]
        exact = [tuple(low[a:b].tobytes() for a, b in zip(starts[i : i + self.lens[w]], stops[i : i + self.lens[w]], strict=True)) == self.words[w] for i, w in zip(begin, window, strict=True)]
        keep = np.array(exact, dtype=bool)
        return begin[keep], window[keep]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int, most: int) -> Iterator[Windows]:
    """The benchmark as blocks of at most about `most` characters, so that no block outgrows memory."""
    run, held = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        run.append((item, text))
        held += len(text or "")
        if held >= most:
            yield Windows(run, size)
            run, held = [], 0
    if run:
        yield Windows(run, size)


class Blocks:
    """Reads numbered objects from the shared folder and keeps the latest few."""

    def __init__(self, folder: str, name: str, n: int) -> None:
        self.folder, self.name, self.n = folder, name, n
        self.held: OrderedDict[int, object] = OrderedDict()

    def __iter__(self) -> Iterator:
        """All in turn, those that are held first."""
        for k in [*self.held, *(k for k in range(self.n) if k not in self.held)]:
            if k not in self.held:
                while len(self.held) >= KEEP:
                    self.held.popitem(last=False)
                self.held[k] = pickle.loads(read_file(f"{self.folder}/{self.name}-{k:06d}"))
            yield k, self.held[k]


class _Chunk:
    """The words of consecutive texts of a batch."""

    def __init__(self, i: int, raw: np.ndarray, at: np.ndarray) -> None:
        self.i = i
        self.low, self.starts, self.stops, self.first, self.codes = tc.words(raw, at)


def _groups(column: pa.Array, n_blocks: int) -> Iterator[list[_Chunk]]:
    """A batch's chunks: one at a time where all blocks are held, else together, so that the blocks are read once for them."""
    chunks = (_Chunk(i, raw, at) for i, _, raw, at in tc.chunks(column))
    if n_blocks > KEEP:
        yield list(chunks)
        return
    for c in chunks:
        yield [c]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, carry: bool = False) -> DataFrame:
    """Which words of which documents lie in windows of benchmark items.

    Returns one row for each row of docs: the id column, n_words, n_hit (words
    inside any occurrence of a window) and item_ids (the items, as strings in
    ascending order, of which a window occurs). An item shorter than a window
    is one window; an item without words, or with null text, has none. The
    windows of items without an id are hit as well, but name no item. Null or
    empty documents have no words. Repeated rows are each reported. Only the
    named columns are read, so others may have any name. Empty tables give no
    rows, or rows without hits. With carry, a column `row` holds each whole row
    of docs, so that decisions on it need no join.

    Documents are read twice, whatever the number of blocks, and never shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"), *own)
    folder, n_blocks = scratch(spark, "windows"), 0
    for block in _blocks(benchmark, item_col, item_text_col, window, block_chars):
        if len(block.words):
            put_file(f"{folder}/vocabulary-{n_blocks:06d}", [pickle.dumps(block.vocab)])
            put_file(f"{folder}/plain-{n_blocks:06d}", [pickle.dumps(block)])
            n_blocks += 1
    counts = _frequencies(docs, folder, n_blocks)
    for k in range(n_blocks):
        block = pickle.loads(read_file(f"{folder}/plain-{k:06d}"))
        documents = np.zeros(len(block.vocab), dtype=np.int64)
        for place, n in counts.where(F.col("block") == k).select("k", "n").collect():  # at most one row for each word of the block
            documents[place] = n
        put_file(f"{folder}/windows-{k:06d}", [pickle.dumps(block.rank(documents))])

    def run(batches):
        blocks = Blocks(folder, "windows", n_blocks)
        for batch in batches:
            items = [[] for _ in range(batch.num_rows)]
            words, hit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for group in _groups(batch.column(1), n_blocks):
                cover = [np.zeros(len(c.codes) + 1, dtype=np.int64) for c in group]
                for _, index in blocks:
                    for c, covered in zip(group, cover, strict=True):
                        if not len(c.codes):
                            continue
                        begin, found = index.hits(c.low, c.starts, c.stops, c.first, c.codes)
                        np.add.at(covered, begin, 1)
                        np.add.at(covered, begin + index.lens[found], -1)
                        text = np.searchsorted(c.first, begin, side="right") - 1
                        for t, w in set(zip(text.tolist(), found.tolist(), strict=True)):
                            items[c.i + t] += (index.items[x] for x in index.of[w])
                for c, covered in zip(group, cover, strict=True):
                    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
                    own = slice(c.i, c.i + len(c.first) - 1)
                    words[own], hit[own] = np.diff(c.first), np.diff(inside[c.first])
            named = [sorted({x for x in found if x is not None}) for found in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(hit), pa.array(named, pa.list_(pa.string())), *batch.columns[2:]], names=[id_col, "n_words", "n_hit", "item_ids", *batch.schema.names[2:]])

    schema = T.StructType([docs.schema[0], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), *docs.schema[2:]])
    return docs.mapInArrow(lean(run), schema)


def _frequencies(docs: DataFrame, folder: str, n_blocks: int) -> DataFrame:
    """For each block (block) and word of its vocabulary (k), the number of documents that hold it (n), over all documents."""

    def run(batches):
        blocks, totals = Blocks(folder, "vocabulary", n_blocks), {}

        def rows():
            for b, n in totals.items():
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), b)), pa.array(k), pa.array(n[k])], names=["block", "k", "n"])
            totals.clear()

        for batch in batches:
            for group in _groups(batch.column(0), n_blocks):
                for b, known in blocks:
                    n = totals.setdefault(b, np.zeros(len(known), dtype=np.int64))
                    for c in group:
                        k = np.searchsorted(known, c.codes)
                        k[k == len(known)] = 0
                        found = known[k] == c.codes
                        pair = np.unique(tc.owners(c.first)[found] * len(known) + k[found])
                        n += np.bincount(pair % len(known), minlength=len(known))
                    if len(totals) >= KEEP and n_blocks > KEEP:
                        yield from rows()
        yield from rows()

    counts = docs.select("__text").mapInArrow(lean(run), "block long, k long, n long").groupBy("block", "k").agg(F.sum("n").alias("n"))
    return stored(counts, "frequencies") if n_blocks else counts

"""Benchmark decontamination: suffix arrays over the training text, searched with every test suffix.

The training text is cut into shards (the slices a task works on). A shard's suffix array
lists its word suffixes in order; every suffix of every benchmark item is looked up in it by
binary search, word by word, which gives the longest verbatim match and all its places.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.arrays import (PrefixHash, Words, byte_set, byte_symbols, covered, lower_table, per_row, runs,
                                 slices)
from tidemark.llm.frames import table_batch

WINDOW = 13
#: Digits, letters and all non-ASCII bytes, after lower-casing A-Z.
WORD_BYTES = ~byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
FIELDS = ("n_words long, n_hit long, longest_match long, items array<string>, "
          "spans array<struct<start: long, end: long>>")


def _hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    low = lower_table()[data]
    words = Words(low, offsets, WORD_BYTES)
    return words, PrefixHash(byte_symbols()[low]).of(words.start, words.end)


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of range, member) for all members of half-open integer ranges."""
    size = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(low)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]


class Probe:
    """All word suffixes of a block of benchmark items, ready to be looked up."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        _, data, offsets = next(slices(pa.array(texts, pa.large_string()), 1 << 62))
        words, hashes = _hashed_words(data, offsets)
        self.vocabulary = np.unique(hashes)
        self.ids = ids
        self.item = words.row
        self.word = np.searchsorted(self.vocabulary, hashes).astype(np.int64) + 1
        size = words.count[words.row]
        self.left = words.first[words.row + 1] - np.arange(len(words.row))  # words up to the item's end
        #: Words of the window that starts at this suffix, 0 for none.
        self.need = np.where(self.left >= np.minimum(window, size), np.minimum(window, size), 0)
        #: Suffixes of the text that don't start with one of these grams match no window.
        self.gram = int(min(3, self.need[self.need > 0].min())) if len(self.word) else 1
        at = np.flatnonzero(self.left >= self.gram)
        self.grams = np.unique(self._grams(self.word, at))

    def _grams(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = word[at].astype(np.uint64)
        for k in range(1, self.gram):
            key = key * np.uint64(0x9E3779B97F4A7C15) + word[at + k].astype(np.uint64)
        return key

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of the text; 0 for a word that no item has."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int64)

    def suffix_array(self, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Suffixes in word order, to the depth of the longest item, sorted one word at a
        time among those that still tie. Suffixes that can match no window are left out."""
        at = np.arange(len(word) - self.gram + 1)
        if not len(at):
            return at
        at = at[(word[at] > 0) & (row[at] == row[at + self.gram - 1])]
        key = self._grams(word, at)
        found = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
        at = at[self.grams[found] == key]
        rank = np.zeros(len(at), np.int64)
        tied = np.arange(len(at))
        for depth in range(int(self.left.max(initial=0))):
            if not len(tied):
                break
            value = self._at(word, row, at[tied], depth)
            order = np.lexsort((value, rank[tied]))
            r, v = rank[tied][order], value[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(r)))
            # A rank is the number of suffixes before the group; ties keep room for refinement.
            block = np.ones(len(r), bool)
            block[1:] = r[1:] != r[:-1]
            start = np.repeat(np.flatnonzero(block), np.diff(np.append(np.flatnonzero(block), len(r))))
            refined = r + (np.repeat(first, size) - start)
            rank[tied[order]] = refined
            ended = v < 0
            tied = tied[order][(np.repeat(size, size) > 1) & ~ended]
        return at[np.argsort(rank, kind="stable")]

    @staticmethod
    def _at(word: np.ndarray, row: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
        """The word ``depth`` places on; -1 behind the end of the text."""
        to = np.minimum(at + depth, len(word) - 1)
        return np.where((at + depth < len(word)) & (row[to] == row[at]), word[to], -1)

    def search(self, word: np.ndarray, row: np.ndarray, array: np.ndarray):
        """For every test suffix: longest match, and the range of places that share its window."""
        n = len(self.word)
        low, high, length = np.zeros(n, np.int64), np.full(n, len(array)), np.zeros(n, np.int64)
        from_, to = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero((self.left >= self.gram) & (high > 0))
        depth = 0
        while len(live):
            live = live[self.left[live] > depth]
            want = self.word[live + depth]
            a = self._bisect(word, row, array, depth, low[live], high[live], want)
            b = self._bisect(word, row, array, depth, low[live], high[live], want + 1)
            hit = b > a
            live, a, b = live[hit], a[hit], b[hit]
            low[live], high[live], length[live] = a, b, depth + 1
            done = self.need[live] == depth + 1
            from_[live[done]], to[live[done]] = a[done], b[done]
            depth += 1
        return length, from_, to

    def _bisect(self, word, row, array, depth, low, high, want):
        low, high = low.copy(), high.copy()
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = np.where(open_, (low + high) // 2, 0)
            less = self._at(word, row, array[mid], depth) < want
            low = np.where(open_ & less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)


def _blocks(benchmark: DataFrame, id: str, text: str, limit: int) -> Iterator[tuple[list[str], list[str]]]:
    """The test set, a block of at most ``limit`` characters (or one item) at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").alias("t"))
    for r in rows.where(F.col("t").isNotNull()).toLocalIterator():
        if texts and size + len(r.t) > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t)
    if texts:
        yield ids, texts


def find_matches(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                 block_chars: int = 8 << 20) -> DataFrame:
    """Per document: words, words inside any occurrence of a test window, items, places.

    Result: the columns ``keep``, n_words, n_hit, longest_match (words of the longest verbatim match of any
    test suffix that reaches a whole window), items (sorted ids), spans (hit word ranges).
    A null text has no words; items without words match nothing; an item shorter than the
    window is one window; items without an id go by "". Rows are judged one by one, so
    repeated rows and ids repeat. The test set travels in blocks of ``block_chars``, each a
    broadcast of that size; documents are never shuffled. Words are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark, item_id, item_text, block_chars)]
    taken = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = StructType([taken.schema[i] for i in range(len(keep))] + list(StructType.fromDDL(FIELDS)))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        # One probe stays in memory if the test set is one block; else they are made in turn.
        only = Probe(*blocks[0].value, window) if len(blocks) == 1 else None
        for batch in batches:
            for first, data, offsets in slices(batch.column(len(keep))):
                n = len(offsets) - 1
                words, hashes = _hashed_words(data, offsets)
                hit = np.zeros(len(words.row), bool)
                longest = np.zeros(n, np.int64)
                items: dict[int, set[str]] = {}
                for block in blocks:
                    probe = only or Probe(*block.value, window)
                    if not len(probe.word):
                        continue
                    word = probe.encode(hashes)
                    array = probe.suffix_array(word, words.row)
                    length, low, high = probe.search(word, words.row, array)
                    owner, place = _expand(low, high)
                    at = array[place]
                    hit |= covered(at, probe.need[owner], len(hit))
                    np.maximum.at(longest, words.row[at], probe.need[owner])
                    # The longest matches lie at the ends of the ranges that were still open.
                    full = np.flatnonzero((length >= probe.need) & (probe.need > 0) & (high > low))
                    o, p = _expand(low[full], high[full])
                    deep = _common(probe, word, words.row, full[o], array[p])
                    np.maximum.at(longest, words.row[array[p]], deep)
                    pairs = np.unique(words.row[at] * len(probe.ids) + probe.item[owner])
                    for r, i in zip(pairs // len(probe.ids), pairs % len(probe.ids)):
                        items.setdefault(int(r), set()).add(probe.ids[i])
                start, end = runs(hit, words.first)
                row = words.row[start] if len(start) else start
                spans = [[] for _ in range(n)]
                for r, s, e in zip(row, start - words.first[row], end - words.first[row]):
                    spans[r].append({"start": int(s), "end": int(e)})
                yield table_batch([batch.column(i).slice(first, n) for i in range(len(keep))] + [
                                   words.count, per_row(hit, words.first), longest,
                                   [sorted(items.get(r, ())) for r in range(n)], spans], arrow)

    return taken.mapInArrow(run, schema)


def _common(probe: Probe, word: np.ndarray, row: np.ndarray, suffix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words that a test suffix and a place of the text share from their starts."""
    size = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    depth = 0
    while len(live):
        live = live[probe.left[suffix[live]] > depth]
        live = live[Probe._at(word, row, at[live], depth) == probe.word[suffix[live] + depth]]
        size[live] = depth + 1
        depth += 1
    return size


def contaminated(n_hit, n_words):
    """A twentieth or more of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names) -> DataFrame:
    """Documents without the contaminated ones, judged row by row in one map; rows without
    words stay. Columns of documents keep their names, whatever they are."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = find_matches(plain, benchmark, plain.columns, f"c{docs.columns.index(text)}", **names)
    return found.where(~contaminated(F.col("n_hit"), F.col("n_words"))).select(*plain.columns).toDF(*docs.columns)


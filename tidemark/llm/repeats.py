"""Removal of long repeated passages, exact to the byte, by a sparse hash-compared suffix sort.

A string of ``LENGTH`` bytes is a window. Every window has an anchor, the smallest of its short
grams by hash, so equal windows have equal anchors at equal places. Windows of one anchor
form two nodes (by which half of the window the anchor lies in); all windows of a node share
a core, and a window can only repeat if its core does. Nodes whose cores repeat, and whose whole
stretch does not, meet in one task per core. There the suffixes that begin at the cores are
mergesorted; two suffixes are compared by their longest common extension, found by binary
search on prefix polynomial hashes. Neighbours give how far any other occurrence agrees to
the right and to the left, and the windows inside these bounds are matched and verified.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import SLICE_BYTES, PrefixHash, byte_symbols, covered, runs, slices
from tidemark.llm.frames import map_texts, materialized, table_batch

LENGTH = 400
GRAM = 64
#: Different stretches of one core that meet in one task; beyond, single windows are counted.
TOGETHER = 20_000
PLACE_BITS = 30
NODES = "array<struct<core: long, stretch: binary, low: int, at: int, high: int>>"


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def nodes_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(row, core, stretch, low, at, high) of all nodes: window starts low..high, core at ``at``,
    stretch the 128-bit BLAKE2 digest of the bytes of all its windows: equal digests, equal bytes."""
    grams = length - gram + 1
    size = np.diff(offsets)
    long_ = np.flatnonzero(size >= length)
    if not len(long_):
        return [np.zeros(0, np.int64)] * 2 + [[]] + [np.zeros(0, np.int64)] * 3
    hashes = PrefixHash(byte_symbols()[data])
    place = np.arange(len(data) - gram + 1)
    key = (hashes.of(place, place + gram) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place.astype(np.uint64)
    anchor = (_sliding_least(key, grams) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    start = np.flatnonzero(covered(offsets[long_], size[long_] - length + 1, len(anchor)))
    anchor = anchor[start]
    half = grams // 2
    late = anchor - start >= half
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (late[1:] != late[:-1])
    first = np.flatnonzero(new)
    low, high = start[first], start[np.append(first[1:], len(start)) - 1]
    at = np.where(late[first], anchor[first] - half, anchor[first])
    end = np.where(late[first], anchor[first] + gram, anchor[first] - (half - 1) + length)
    row = np.searchsorted(offsets, low, "right") - 1
    base = offsets[row]
    raw = memoryview(data)
    digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), (high + length).tolist())]
    return [row, hashes.of(at, end).view(np.int64), digest, low - base, at - base, high - base]


def scan(docs: DataFrame, id: str, text: str, length: int, gram: int) -> DataFrame:
    """id, n_bytes, text_key (digest of the text), nodes."""
    def measure(data, offsets):
        row, core, stretch, low, at, high = nodes_of(data, offsets, length, gram)
        first = np.searchsorted(row, np.arange(len(offsets)))
        parts = [pa.array(core, pa.int64()), pa.array(stretch, pa.binary()), *[pa.array(x, pa.int32()) for x in (low, at, high)]]
        nodes = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(
            parts, ["core", "stretch", "low", "at", "high"]))
        raw = memoryview(data)
        keys = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets, offsets[1:])]
        return [np.diff(offsets), pa.array(keys, pa.binary()), nodes]

    return map_texts(docs, [id], text, f"n_bytes long, text_key binary, nodes {NODES}", measure)


class Suffixes:
    """Suffixes of a byte buffer, each up to its own end, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.end = data, start, end
        self.hashes = PrefixHash(byte_symbols()[data])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension of pairs: binary search for the longest equal prefix."""
        a, b = self.start[i], self.start[j]
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.end[i] - a, self.end[j] - b)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) // 2
            x, y = a[open_], b[open_]
            same = self.hashes.of(x, x + mid) == self.hashes.of(y, y + mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        a, b = self.start[i] + n, self.start[j] + n
        ends_a, ends_b = a >= self.end[i], b >= self.end[j]
        top = len(self.data) - 1
        return np.where(ends_a | ends_b, ends_a & ~ends_b, self.data[np.minimum(a, top)] < self.data[np.minimum(b, top)])

    def sorted_within(self, first: np.ndarray) -> np.ndarray:
        """Order of the suffixes inside each group (suffixes first[g]..first[g+1]): a bottom-up
        mergesort in which all elements of all runs find their place at once."""
        order = np.arange(first[-1])
        group = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside, size = order - first[group], np.diff(first)[group]
        width = 1
        while len(order) and width < size.max():
            live = np.flatnonzero(size > width)
            at = inside[live]
            base = first[group[live]]
            block = at // (2 * width) * (2 * width)
            left = at - block < width
            low = np.where(left, np.minimum(block + width, size[live]), block)
            high = np.where(left, np.minimum(block + 2 * width, size[live]), block + width)
            begin = low.copy()
            mine = order[live]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                theirs = order[base[open_] + mid]
                # Ties keep the left run first.
                goes_on = np.where(left[open_], self.less(theirs, mine[open_]), ~self.less(mine[open_], theirs))
                low[open_[goes_on]] = mid[goes_on] + 1
                high[open_[~goes_on]] = mid[~goes_on]
            to = block + (at - block - np.where(left, 0, width)) + (low - begin)
            moved = order.copy()
            moved[base + to] = mine
            order = moved
            width *= 2
        return order

    def furthest(self, first: np.ndarray) -> np.ndarray:
        """For each suffix the longest extension that any other of its group shares."""
        order = self.sorted_within(first)
        best = np.zeros(len(order), np.int64)
        group = np.repeat(np.arange(len(first) - 1), np.diff(first))
        pair = np.flatnonzero(group[1:] == group[:-1])
        shared = self.common(order[pair], order[pair + 1])
        np.maximum.at(best, order[pair], shared)
        np.maximum.at(best, order[pair + 1], shared)
        return best


def repeated_windows(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, first: np.ndarray, length: int):
    """Window starts (context, place in it) that occur at two places of their group or more.

    Contexts are the rows of (data, offsets); ``at`` is where the core begins in each, ``first``
    where each group of equal cores begins.
    """
    begin, end = offsets[:-1], offsets[1:]
    right = Suffixes(data, begin + at, end).furthest(first)
    n = len(data)
    left = Suffixes(data[::-1], n - (begin + at), n - begin).furthest(first)
    low = np.maximum(0, at - left)
    high = np.minimum(end - begin - length, at + right - length)
    count = np.maximum(high - low + 1, 0)
    context = np.repeat(np.arange(len(at)), count)
    start = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count) + low[context]
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))[context]
    place = begin[context] + start
    key = PrefixHash(byte_symbols()[data]).of(place, place + length)
    order = np.lexsort((key, group))
    same = (key[order][1:] == key[order][:-1]) & (group[order][1:] == group[order][:-1])
    pair = np.flatnonzero(same)
    # Verify: equal hashes must be equal bytes; a run of equal hashes that holds others is
    # ordered by its bytes instead.
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    true = np.ones(len(pair), bool)
    for k in range(0, len(pair), 8192):
        a, b = place[order[pair[k:k + 8192]]], place[order[pair[k:k + 8192] + 1]]
        true[k:k + 8192] = (view[a] == view[b]).all(axis=1)
    if not true.all():
        run = np.cumsum(np.append(True, ~same)) - 1
        inside = np.isin(run, run[pair[~true]])
        mixed = order[inside]
        by_bytes = np.lexsort((*view[place[mixed]].T[::-1], run[inside]))
        order[inside] = mixed[by_bytes]
        again = inside[pair]
        true[again] = (view[place[order[pair[again]]]] == view[place[order[pair[again] + 1]]]).all(axis=1)
        pair = pair[true]
    twice = np.zeros(len(order), bool)
    twice[order[pair]] = True
    twice[order[pair + 1]] = True
    return context[twice], start[twice]


def _batches_of_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Sorted rows in tables that hold whole groups of the first column, about ``limit`` bytes each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        core = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.append(np.flatnonzero(core[1:] != core[:-1]) + 1, len(core))
        if held and len(core) and held[-1].column(0)[-1].as_py() != core[0] and size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        start = 0
        for cut in cuts:
            part = batch.slice(start, cut - start)
            size += part.nbytes
            if size >= limit and cut < len(core):
                held.append(batch.slice(start, cut - start))
                yield pa.Table.from_batches(held)
                held, size = [], 0
            else:
                held.append(part)
            start = cut
    if held:
        yield pa.Table.from_batches(held)


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM):
    """(rows: id, n_bytes, text_key; texts: text_key, text, spans of repeated bytes).

    Equal texts are one row of ``texts``; only texts with repeated bytes have one.
    """
    seen = materialized(scan(docs, id, text, length, gram))
    rows = seen.select(id, "n_bytes", "text_key")
    unique = seen.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"),
                                          F.first("nodes").alias("nodes"))
    unique = materialized(unique.where(F.col("n_bytes") >= length))
    nodes = unique.select("text_key", F.inline("nodes"))
    # Written, so that the join below has two plain shuffles and Spark can split a hot core.
    cores = materialized(nodes.groupBy("core").count().where("count > 1").select("core"))
    nodes = materialized(nodes.join(cores, "core"))
    kinds = nodes.groupBy("core", "stretch").agg(F.count(F.lit(1)).alias("alike"), F.min(F.struct("text_key", "low")).alias("sample"))
    per_core = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = materialized(kinds.join(per_core, "core"))
    nodes = materialized(nodes.join(kinds, ["core", "stretch"]))
    alike = nodes.where("alike > 1").select("text_key", F.col("low").alias("start"), (F.col("high") + length).alias("end"))
    # Every different stretch of a core is compared once; its copies share the answer.
    open_ = nodes.where((F.col("kinds") > 1) & (F.struct("text_key", "low") == F.col("sample")))
    wanted = open_.groupBy("text_key").agg(F.collect_list(F.struct("core", "low", "at", "high", "kinds")).alias("open"))
    touched = wanted.join(unique.where("copies > 1").select("text_key").union(nodes.select("text_key")).distinct(), "text_key", "right")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    texts = docs.select(F.unhex(F.sha2(whole, 256)).alias("text_key"), whole.alias("text")).groupBy("text_key").agg(
        F.first("text").alias("text"))
    texts = materialized(texts.join(touched, "text_key"))
    contexts = _contexts(texts, length)
    found = _compared(contexts.where(F.col("kinds") <= TOGETHER), length)
    crowded = contexts.where(F.col("kinds") > TOGETHER)
    found = found.union(_counted(crowded, length)) if nodes.where(F.col("kinds") > TOGETHER).limit(1).count() else found
    copies = unique.where("copies > 1").select("text_key", F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end"))
    spans = alike.union(found).union(copies).groupBy("text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return rows, texts.select("text_key", "text").join(spans, "text_key")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """(core, at, text_key, low, kinds, context) of every open node: bytes of all its windows."""
    schema = "core long, at int, text_key binary, low int, kinds long, context binary"

    def run(batches):
        arrow = pa.schema([("core", pa.int64()), ("at", pa.int32()), ("text_key", pa.binary()), ("low", pa.int32()),
                           ("kinds", pa.int64()), ("context", pa.binary())])
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            size = 0
            for key, text, nodes in zip(*[batch.column(i) for i in range(3)]):
                raw, key = text.as_py().encode(), key.as_py()
                for node in nodes.as_py() or ():
                    part = raw[node["low"]:node["high"] + length]
                    for to, x in zip(out, (node["core"], node["at"] - node["low"], key, node["low"], node["kinds"], part)):
                        to.append(x)
                    size += len(part)
                if size >= SLICE_BYTES:
                    yield table_batch(out, arrow)
                    out, size = [[] for _ in range(6)], 0
            if out[0]:
                yield table_batch(out, arrow)

    return texts.where("open IS NOT NULL").select("text_key", "text", "open").mapInArrow(run, schema)


_SPANS = pa.schema([("text_key", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])


def _spans_batch(keys: list, low: np.ndarray, context: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Consecutive window starts of one context as one span."""
    new = np.ones(len(start), bool)
    new[1:] = (context[1:] != context[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    at = low[context[first]]
    return table_batch([[keys[c] for c in context[first]], at + start[first], at + start[last] + length], _SPANS)


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows among the contexts of each core, one task per group of cores."""
    dealt = contexts.select("core", "at", "text_key", "low", "context").repartition("core").sortWithinPartitions("core")

    def run(batches):
        for table in _batches_of_groups(batches, SLICE_BYTES):
            core = table.column(0).to_numpy()
            first = np.append(np.flatnonzero(np.append(True, core[1:] != core[:-1])), len(core))
            parts = table.column(4).to_pylist()
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            data = np.frombuffer(b"".join(parts), np.uint8)
            context, start = repeated_windows(data, offsets, table.column(1).to_numpy().astype(np.int64), first, length)
            if len(context):
                yield _spans_batch(table.column(2).to_pylist(), table.column(3).to_numpy().astype(np.int64), context, start, length)

    return dealt.mapInArrow(run, "text_key binary, start int, end int")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """The same for cores with very many different stretches: windows are counted by digest,
    in an aggregation that combines on the map side."""
    digest = F.md5(F.substring(F.col("context"), F.col("i") + 1, F.lit(length)))
    windows = contexts.select("text_key", "low", "context", F.explode(F.sequence(F.lit(0), F.length("context") - length)).alias("i"))
    windows = materialized(windows.select("text_key", (F.col("low") + F.col("i")).cast("int").alias("start"), digest.alias("w")))
    twice = windows.groupBy("w").count().where("count > 1").select("w")
    return windows.join(twice, "w").select("text_key", "start", (F.col("start") + length).cast("int").alias("end"))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   keep_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row.

    Each byte inside a string of ``length`` bytes that also starts at another place, of the same
    text or any other, is removed; all judged on the input. Texts are UTF-8 bytes; null is empty;
    a text shorter than ``length`` keeps everything; cuts may fall inside a character
    (kept bytes of untouched rows are null). Rows go by their texts: null or repeated ids stay rows,
    and a text that two rows hold is removed from both.
    """
    rows, texts = repeated_spans(docs, id, text, length, gram)

    def cut(data: bytes, spans: list) -> tuple[int, int, bytes]:
        flags = covered(np.array([s["start"] for s in spans]), np.array([s["end"] - s["start"] for s in spans]), len(data))
        return int(flags.sum()), len(runs(flags, np.array([0, len(data)]))[0]), np.frombuffer(data, np.uint8)[~flags].tobytes()

    def run(batches):
        arrow = pa.schema([("_key", pa.binary()), ("removed", pa.int64()), ("spans", pa.int64()), ("sha", pa.string()), ("kept", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                found = [cut(t.encode(), s) for t, s in zip(part["text"], part["spans"])]
                yield table_batch([part["text_key"], [f[0] for f in found], [f[1] for f in found],
                                   [hashlib.sha256(f[2]).hexdigest() for f in found], [f[2] if keep_text else None for f in found]], arrow)

    cuts = materialized(texts.mapInArrow(run, "_key binary, removed long, spans long, sha string, kept binary"))
    out = rows.join(cuts, F.col("text_key") == F.col("_key"), "left").select(
        id, "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", F.lower(F.hex("text_key"))).alias("kept_sha256"), *(["kept"] if keep_text else []))
    return out

"""Packing of token pieces into sequences of fixed capacity.

Only the histogram of piece lengths (at most ``capacity`` numbers) comes to the driver. A
configuration linear program over it is solved by multiplicative weights, each step pricing
the best configuration by a knapsack dynamic program; configurations are rounded down and
what is left is placed by best fit. The plan is a list of length ranks, which Spark joins
with the pieces.
"""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.frames import materialized, table_batch
from tidemark.llm.tokens import encoder

CAPACITY = 2048
#: Size classes of the linear program, and its steps.
CLASSES, STEPS, RATE = 128, 2500, 0.25
#: Pieces that one window task ranks, about.
RANKED = 1 << 19
#: Rows of the plan up to which it is broadcast (at most 5 MB); a larger plan is joined.
BROADCAST_ROWS = 100_000


def token_pieces(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text",
                 capacity: int = CAPACITY, end_id: int = 0, ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every text, an end id behind each text.

    Result: the columns ``keep``, piece (from 0), start (tokens before it), length,
    ids_crc32, and the ids themselves if asked for. Only longer texts are cut; all pieces
    are full but the first. A null or empty text is one piece of the end id.
    """
    taken = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    fields = "piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if ids else "")
    schema = StructType([taken.schema[i] for i in range(len(keep))] + list(StructType.fromDDL(fields)))
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, encode = to_arrow_schema(schema), encoder(path).encode
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                part = batch.slice(row, 512)
                found: list[list] = [[] for _ in range(6)]
                for i, packed in enumerate(encode(part.column(len(keep)).to_pylist())):
                    packed += tail
                    n = len(packed) // 4
                    at, end = 0, n - (n - 1) // capacity * capacity
                    piece = 0
                    while at < n:
                        raw = packed[4 * at:4 * end]
                        for to, x in zip(found, (i, piece, at, end - at, zlib.crc32(raw), np.frombuffer(raw, "<u4") if ids else None)):
                            to.append(x)
                        at, end, piece = end, end + capacity, piece + 1
                rows = pa.array(found[0], pa.int64())
                yield table_batch([part.column(i).take(rows) for i in range(len(keep))] + found[1:6 if ids else 5], arrow)

    return taken.mapInArrow(run, schema)


def price(value: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """Copies of each class in the most valuable configuration: unbounded knapsack."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = np.searchsorted(size, c, "right")
        best[c], last[c] = best[c - 1], -1
        if fits:
            total = best[c - size[:fits]] + value[:fits]
            k = int(total.argmax())
            if total[k] > best[c]:
                best[c], last[c] = total[k], k
    out, c = np.zeros(len(size), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= size[last[c]]
    return out


def solve(size: np.ndarray, need: np.ndarray, room: int, steps: int = STEPS, rate: float = RATE, gap: float = 0.01):
    """Fractional configurations that cover ``need`` items of each class; (configuration, amount).

    Multiplicative weights: a class loses weight as it gets covered. The dual bound of the
    best prices tells how far the cover can be from the optimum; the search ends at ``gap``.
    """
    found: dict[tuple, float] = defaultdict(float)
    covered, weight, bound, total = np.zeros(len(size)), np.ones(len(size)), 0.0, 0.0
    for _ in range(steps):
        value = weight / need
        one = price(value, size, room)
        bound = max(bound, float(weight.sum() / (value @ one)))
        amount = float((need[one > 0] / one[one > 0]).min())
        found[tuple(one)] += amount
        total += amount
        gain = amount * one / need
        covered += gain
        weight = weight * np.exp(-rate * gain)
        weight /= weight.max()
        least = covered.min()
        if least > 0 and total / least <= (1 + gap) * bound:
            break
    least = max(covered.min(), 1e-9)
    return {k: v / least for k, v in found.items()} if covered.min() > 0 else dict(found)


class Plan:
    """Groups of equal sequences: lengths in order, how many."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[list]] = defaultdict(list)

    def add(self, lengths: tuple, n: int) -> None:
        """lengths: ((length, copies), ...)"""
        if n:
            self.by_room[self.capacity - sum(a * b for a, b in lengths)].append([lengths, n])

    def best_fit(self, length: int, n: int) -> None:
        """Place n equal pieces, each into the fullest sequence that has room."""
        while n:
            room = next((r for r in range(length, self.capacity + 1) if self.by_room.get(r)), None)
            if room is None:
                break
            lengths, many = self.by_room[room].pop()
            take = min(many, n)
            each = min(room // length, n // take)
            self.add(lengths + ((length, each),), take)
            self.add(lengths, many - take)
            n -= take * each
        each = self.capacity // length
        self.add(((length, each),), n // each)
        if n % each:
            self.add(((length, n % each),), 1)

    def groups(self) -> list[list]:
        return [g for room in sorted(self.by_room) for g in self.by_room[room]]

    def size(self) -> int:
        return sum(n for _, n in self.groups())


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Sequences for a histogram of lengths: rounded configurations, the rest by best fit.

    Fullest configurations come first, each as often as its items last. Rounding lengths up
    to classes leaves slack, so sequences that are not nearly full are taken apart again and
    their pieces go to best fit: as much of the configurations stays as needs no more sequences
    than best fit alone. Best fit alone stands only if no part of them does.
    """
    plain = _best_fit(Plan(capacity), histogram)
    grain = max(1, -(-capacity // CLASSES))
    queues: dict[int, list[list[int]]] = defaultdict(list)
    for length in sorted(histogram):
        queues[-(-length // grain)].append([length, histogram[length]])
    room = capacity // grain
    size = np.array(sorted(c for c in queues if c <= room), np.int64)
    rounded = Plan(capacity)
    if len(size):
        left = np.array([sum(n for _, n in queues[c]) for c in size], np.int64)
        fractions = solve(size, left.astype(float), room)
        for one, amount in sorted(fractions.items(), key=lambda x: -int(np.dot(x[0], size))):
            copies = np.array(one)
            used = np.flatnonzero(copies)
            n = int(min(np.floor(amount), (left[used] // copies[used]).min()))
            if n <= 0 or int(copies @ size) * 50 < 49 * room:
                continue
            left[used] -= n * copies[used]
            _fill(rounded, [(queues[size[k]], int(copies[k])) for k in used], n)
    rest = {x: n for queue in queues.values() for x, n in queue if n}
    whole = _best_fit(rounded, rest)
    if whole.size() <= plain.size():
        return whole
    for slack, share in [(capacity // 512, 1), (0, 1), *[(0, k) for k in (2, 4, 8)]]:
        kept, taken = Plan(capacity), defaultdict(int)
        for lengths, n in whole.groups():
            stay = n // share if capacity - sum(a * b for a, b in lengths) <= slack else 0
            kept.add(tuple(lengths), stay)
            for a, b in lengths:
                taken[a] += b * (n - stay)
        tried = _best_fit(kept, taken)
        if tried.size() <= plain.size():
            return tried
    return plain


def _best_fit(plan: Plan, histogram: dict[int, int]) -> Plan:
    for length in sorted(histogram, reverse=True):
        plan.best_fit(length, histogram[length])
    return plan


def _fill(plan: Plan, slots: list[tuple[list[list[int]], int]], n: int) -> None:
    """n sequences with so many pieces from each queue of [length, count], longest first."""
    while n:
        many = n
        for queue, copies in slots:
            while not queue[-1][1]:
                queue.pop()
            many = min(many, max(1, queue[-1][1] // copies))
        lengths: list[int] = []
        for queue, copies in slots:
            if queue[-1][1] >= copies:
                lengths += [queue[-1][0]] * copies
                queue[-1][1] -= many * copies
            else:  # one sequence whose copies differ in length
                for _ in range(copies):
                    while not queue[-1][1]:
                        queue.pop()
                    lengths.append(queue[-1][0])
                    queue[-1][1] -= 1
        plan.add(_joined(lengths), many)
        n -= many


def _joined(lengths: list[int]) -> tuple:
    out: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        if out and out[-1][0] == x:
            out[-1][1] += 1
        else:
            out.append([x, 1])
    return tuple(map(tuple, out))


def places(groups: list[list]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies, first sequence, offset) of every slot."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, n in groups:
        offset = 0
        for length, copies in lengths:
            out.append((length, used[length], used[length] + n * copies, copies, sequence, offset))
            used[length] += n * copies
            offset += length * copies
        sequence += n
    return out


def pack(pieces: DataFrame, length: str = "length", order: Sequence[str] = ("doc_id", "piece", "start", "ids_crc32"),
         capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; every sequence is gapless from 0.

    Pieces of one length are interchangeable: each gets its rank among them, and the plan
    says where a rank goes. A length that many pieces share is ranked in salted buckets whose
    counts are added up first. Equal rows may trade places, nothing else depends on their
    order. Lengths must lie in 1..capacity. ``pieces`` is read several times: pass a written table.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `capacity` rows
    groups = plan(histogram, capacity).groups() if histogram else []
    rows = places(groups)
    spans = spark.createDataFrame(rows, "_length long, _from long, _to long, _copies long, _first long, _at long")
    salts = max(histogram.values(), default=0) // RANKED + 1
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(length, "_salt").count().select(
        F.col(length).alias("_l"), F.col("_salt").alias("_s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(length, "_salt").orderBy(*order)) - 1
    ranked = salted.withColumn("_rank", within).join(counts, (F.col(length) == F.col("_l")) & (F.col("_salt") == F.col("_s")))
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    if len(rows) <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    hit = (F.col(length) == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    place = F.col("_rank") - F.col("_from")
    return ranked.join(spans, hit).select(
        *pieces.columns, (F.col("_first") + F.floor(place / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(place, F.col("_copies")) * F.col(length)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; see ``token_pieces`` and ``pack``."""
    pieces = materialized(token_pieces(docs, path, [id], text, capacity, ids=ids))
    return pack(pieces, order=(id, "piece", "start", "ids_crc32"), capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that carry their ids: at most
    ``capacity`` ids a sequence, so each group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_p")).select("sequence_id", F.flatten(F.col("_p.ids")).alias("ids"))

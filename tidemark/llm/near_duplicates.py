"""Near-duplicate documents by HyperMinHash sketches, then exact confirmation.

A text's set of word shingles is summarised by ``REGISTERS`` registers. Each is the smallest
hash of the set under its own function, compressed to a count of leading zeros and a few
mantissa bits. Bands of registers find candidates; an estimate of the Jaccard similarity that
is corrected for register collisions drops hopeless pairs; the rest is confirmed on full sets.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import PrefixHash, Words, byte_set, byte_symbols, lower_table, mixed, slices
from tidemark.llm.frames import map_texts, materialized, table_batch
from tidemark.llm.graph import components

SHINGLE = 5
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: 54 bands of 7 registers: two sets with Jaccard 0.85 share no band once in 10**9 pairs.
BANDS, ROWS = 54, 7
REGISTERS = BANDS * ROWS
#: Leading zeros of a 32-bit hash fit 5 bits; with the mantissa a register is a byte.
MANTISSA = 3
#: A pair is compared in full unless its estimate lies this many standard errors below.
DOUBT = 6.0
#: Documents of a cluster that one task compares; larger clusters are cut into tiles.
TILE = 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of all rows, where each row's begin).

    A text with fewer words than a shingle has one shingle, the whole sequence; a text
    without words has none.
    """
    low = lower_table()[data]
    words = Words(low, offsets, NOT_SPACE)
    seq = PrefixHash(PrefixHash(byte_symbols()[low]).of(words.start, words.end))
    at = words.windows(SHINGLE)
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    value = np.concatenate([seq.of(at, at + SHINGLE), seq.of(words.first[short], words.first[short + 1])])
    row = np.concatenate([words.row[at], short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(row[new], np.arange(len(offsets)))


def set_key(value: np.ndarray) -> bytes | None:
    """Digest of a whole sorted set; None for the empty one."""
    return hashlib.blake2b(value.tobytes(), digest_size=16).digest() if len(value) else None


def _functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64))
    return (seeds[:REGISTERS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[REGISTERS:] >> np.uint64(32)).astype(np.uint32)


def compress(least: np.ndarray) -> np.ndarray:
    """Registers of 32-bit minima: leading zeros and the bits behind the leading one."""
    exponent = np.frexp(least.astype(np.float64))[1]  # bits in use
    zeros = 32 - exponent
    mantissa = np.where(exponent > MANTISSA, least >> np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint32), least) & ((1 << MANTISSA) - 1)
    return (np.minimum(zeros, 31) << MANTISSA | mantissa).astype(np.uint8)


def sketches(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of registers per set; sets without shingles get zeros."""
    n = len(first) - 1
    out = np.zeros((n, REGISTERS), np.uint8)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        x = (value ^ (value >> np.uint64(32))).astype(np.uint32)
        a, b = _functions()
        for k in range(REGISTERS):
            h = x * a[k] + b[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out[full, k] = compress(np.minimum.reduceat(h, first[full]))
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit value per band: a hash of its number and its registers side by side."""
    wide = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(wide.shape[:2], np.uint64)
    for k in range(ROWS):
        key = key << np.uint64(8) | wide[:, :, k]
    return mixed(key << np.uint64(8) | np.arange(BANDS, dtype=np.uint64))


@lru_cache(4096)
def collision(size: int) -> float:
    """Chance that the minima of two unrelated sets of this size fall into one register value:
    both are about 1 / size, so leading zeros and mantissa agree by accident."""
    zeros, m = np.meshgrid(np.arange(32), np.arange(1 << MANTISSA))
    low = (1 + m / (1 << MANTISSA)) * 2.0 ** -(zeros + 1)
    high = low + 2.0 ** -(zeros + 1 + MANTISSA)
    return float(((np.exp(-size * low) - np.exp(-size * high)) ** 2).sum())


def estimate(equal: np.ndarray, size: int) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less what collisions add, for a
    set of ``size`` and sets of about that size."""
    chance = collision(size)
    return np.maximum(0.0, (equal - chance) / (1.0 - chance))


def sketch_texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, n_shingles, set_key (digest of the full set), bands (array of band keys)."""
    def measure(data, offsets):
        value, first = shingle_sets(data, offsets)
        keys = [set_key(value[a:b]) for a, b in zip(first, first[1:])]
        bands = band_keys(sketches(value, first)).view(np.int64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1) * BANDS, pa.int32()), pa.array(bands.ravel(), pa.int64()))
        return [np.diff(first), pa.array(keys, pa.binary()), flat]

    return map_texts(docs, [id], text, "n_shingles long, set_key binary, bands array<long>", measure)


def linked_pairs(value: np.ndarray, first: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the given sets: every link's ends end up joined.

    Sets are taken by size; each is compared with the earlier ones whose size allows a link,
    that are not yet in its component and whose estimate leaves hope, best estimate first.
    """
    sizes = np.diff(first)
    n = len(sizes)
    registers = sketches(value, first)
    order = np.argsort(sizes, kind="stable")
    links: list[tuple[int, int]] = []
    limit = percent / 100
    slack = DOUBT * np.sqrt(limit * (1 - limit) / REGISTERS)
    label = np.arange(n)
    for k in range(1, n):
        i = order[k]
        low = np.searchsorted(sizes[order[:k]], sizes[i] * limit - 1e-9)
        others = order[low:k]
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        equal = (registers[others] == registers[i]).mean(axis=1)
        guess = estimate(equal, int(sizes[i]))
        hope = np.argsort(-guess, kind="stable")
        mine = value[first[i]:first[i + 1]]
        for j in others[hope[guess[hope] >= limit - slack]]:
            if label[j] == label[i]:
                continue
            theirs = value[first[j]:first[j + 1]]
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            both = int((mine[at] == theirs).sum())
            if 100 * both >= percent * (len(mine) + len(theirs) - both):
                links.append((int(i), int(j)))
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return links


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal leading columns in sorted batches; only one run is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(keys)]
        start = 0
        for r, key in enumerate(zip(*cols)):
            if key != last:
                if r > start:
                    held.append(batch.slice(start, r - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], r, key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links), kept, for every row.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their shingle sets. Equal sets
    are one class; only one text per class is compared further. Classes that share a band
    form candidate clusters; each cluster's texts meet in one task (clusters over ``TILE``: in
    tiles, every two of which meet), where links are confirmed on full sets. Tasks return
    spanning forests, never all pairs. Texts without words are linked with nothing and kept.
    Rows with a null id take part: they get their class's component and are not kept unless
    nothing else is. Repeated ids stay rows, their components are merged only if linked.
    """
    out = _grouped(docs, id, text, percent)
    component = F.when(F.col("set_key").isNull(), F.col(id)).otherwise(F.col("component"))
    return out.select(id, "n_shingles", component.alias("component_id"), F.col(id).eqNullSafe(component).alias("kept"))


def _grouped(docs: DataFrame, id: str, text: str, percent: int) -> DataFrame:
    """id, n_shingles, set_key, root (class that names the component), component (its least id)."""
    seen = materialized(sketch_texts(docs, id, text))
    ids = seen.where(F.col("set_key").isNotNull())
    classes = materialized(ids.groupBy("set_key").agg(F.min(id).alias("least"), F.first("bands").alias("bands")))
    # Bands that two classes share; every member is tied to the smallest class of the band.
    # Classes go by a 64-bit name here: should two share it, their clusters are one, no more.
    bands = classes.select(F.xxhash64("set_key").alias("name"), F.explode("bands").alias("band"))
    tops = bands.groupBy("band").agg(F.min("name").alias("top"), F.max("name").alias("_other"))
    tops = materialized(tops.where("top <> _other").drop("_other"))
    edges = bands.join(tops, "band").select(F.col("name").alias("a"), F.col("top").alias("b"))
    clusters = components(edges.where("a <> b").distinct())
    links = materialized(_confirmed(docs, id, text, classes, clusters, percent))
    roots = components(links)
    members = classes.join(roots, F.col("set_key") == F.col("node"), "left").select(
        "set_key", "least", F.coalesce("root", "set_key").alias("root"))
    smallest = members.groupBy("root").agg(F.min("least").alias("component"))
    of = materialized(members.join(smallest, "root").select(F.col("set_key").alias("_k"), "root", "component"))
    return seen.join(of, F.col("set_key") == F.col("_k"), "left").select(id, "n_shingles", "set_key", "root", "component")


def _confirmed(docs: DataFrame, id: str, text: str, classes: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of one cluster, as spanning forests."""
    sizes = clusters.groupBy("root").count()
    tiles = F.ceil(F.col("count") / TILE).cast("int")
    placed = clusters.join(sizes, "root").select("root", "node", tiles.alias("tiles")).join(
        classes.select("set_key", "least"), F.col("node") == F.xxhash64("set_key"))
    tile = F.pmod(F.xxhash64("set_key"), F.col("tiles")).cast("int")
    # A tile meets every tile, itself included: one row for each meeting it takes part in.
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, tile).alias("x"), F.greatest(t, tile).alias("y")))
    placed = materialized(placed.select("root", "set_key", F.col("least").alias("_id"), meets.alias("meets")))
    whole = docs.select(F.col(f"`{id}`").alias("_i"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    # The same join at every size: texts are dealt by id, the much smaller placement is hashed.
    meeting = whole.join(placed.hint("shuffle_hash"), F.col("_i").eqNullSafe(F.col("_id"))).select("root", F.explode("meets").alias("m"), "set_key", "_text")
    dealt = meeting.select("root", "m.x", "m.y", "set_key", "_text")
    dealt = dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
    result = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        for group in _groups(batches, 3):
            found: dict[bytes, np.ndarray] = {}
            texts, at = group.column(4).combine_chunks(), 0
            keys = group.column(3).to_pylist()
            for _, data, offsets in slices(texts):
                value, first = shingle_sets(data, offsets)
                for k in range(len(offsets) - 1):
                    mine = value[first[k]:first[k + 1]]
                    # Rows that share an id may differ in text: only the class's own set counts.
                    if keys[at] not in found and set_key(mine) == keys[at]:
                        found[keys[at]] = mine
                    at += 1
            names = list(found)
            first = np.concatenate([[0], np.cumsum([len(found[k]) for k in names])]).astype(np.int64)
            links = linked_pairs(np.concatenate(list(found.values())), first, percent) if len(names) > 1 else []
            if links:
                yield table_batch([[names[i] for i, _ in links], [names[j] for _, j in links]], result)

    return dealt.mapInArrow(run, "a binary, b binary")


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One document of each component stays, the one with the smallest id (of several with that
    id, the one whose set's digest is smallest); texts without words all stay. Columns keep
    their names. Texts are shuffled once, by (id, set): copies of one text spread over tasks.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, key, body = docs.toDF(*names), names[docs.columns.index(id)], names[docs.columns.index(text)]

    def set_keys(data, offsets):
        value, first = shingle_sets(data, offsets)
        return [pa.array([set_key(value[a:b]) for a, b in zip(first, first[1:])], pa.binary())]

    keyed = map_texts(plain, names, body, "_set binary", set_keys)
    found = _grouped(plain, key, body, percent).where(F.col("set_key").isNotNull() & F.col(key).eqNullSafe(F.col("component")))
    chosen = found.groupBy("root").agg(F.min(F.struct("set_key", key)).alias("c")).select(
        F.xxhash64(f"c.{key}", "c.set_key").alias("_name"), F.col("c.set_key").alias("_s"), F.col(f"c.{key}").alias("_i"))
    named = keyed.where(F.col("_set").isNotNull()).withColumn("_row", F.xxhash64(key, "_set"))
    same = (F.col("_row") == F.col("_name")) & (F.col("_set") == F.col("_s")) & F.col(key).eqNullSafe(F.col("_i"))
    kept = named.join(chosen.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["_row"]).select(*names)
    return kept.union(keyed.where(F.col("_set").isNull()).select(*names)).toDF(*docs.columns)

"""Spelling variants: words one edit apart, found by dense tiles of padded words.

Words are dealt into blocks, padded matrices of code points. A pair of blocks is compared as a
whole: two words are one edit apart exactly if their common prefix and their common suffix
together reach the longer one's length minus one. Block pairs that share neither a beginning
nor an end of half a word cannot hold such words and are not compared.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import materialized

#: Letters of words after lower-casing A-Z: a-z and U+00C0 to U+00FF.
LETTERS = "[a-z\u00c0-\u00ff]"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: One occurrence in so many, chosen by its hash, has a letter dropped.
DROP_EVERY = 199
#: Words of a block, and code points of a block at most (one word may be longer).
BLOCK, BLOCK_POINTS = 512, 1 << 20
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 17


def word_counts(docs: DataFrame, least: int = 6, drop_every: int = DROP_EVERY, name: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of at least ``least`` letters over all texts.

    An occurrence whose crc32 of ``<id>:<run>`` is divisible by ``drop_every`` loses the letter
    that the hash names. Whole texts; a null text has no words, a null id counts as an empty one.
    """
    runs = re.compile(f"{LETTERS}{{{least},}}")  # a run is maximal: shorter ones never count

    def run(batches):
        held: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc, content in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
                content = content.as_py()
                if not content:
                    continue
                start = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for word, n in Counter(runs.findall(content.translate(LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % drop_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    taken = docs.select(F.col(f"`{name}`").cast("string"), F.col(f"`{text}`").cast("string"))
    return taken.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of every row of ``a`` with every row of ``b``."""
    alive = np.ones((len(a), len(b)), bool)
    out = np.zeros((len(a), len(b)), np.uint8 if a.shape[1] < 250 else np.int32)
    columns = np.ascontiguousarray(b.T)
    for t in range(min(a.shape[1], b.shape[1])):
        alive &= a[:, t, None] == columns[t]
        if not alive.any():
            break
        out += alive
    return out


def one_edit(a: np.ndarray, b: np.ndarray, head: int | None = None, side: int = 0) -> np.ndarray:
    """Which rows of ``a`` and ``b`` differ by exactly one edit; all rows of ``b`` are as long or one longer.

    With ``head``, only pairs whose common prefix has that many letters (side 0) or fewer (side 1).
    """
    prefix = common_prefix(a, b)
    near = (prefix < b.shape[1]) & (prefix + common_prefix(a[:, ::-1], b[:, ::-1]) >= b.shape[1] - 1)
    if head is not None:
        near &= (prefix >= head) == (side == 0)
    return near


def _points(words: list[str], length: int) -> np.ndarray:
    """Words of one length as a matrix of code points, in the narrowest numbers that hold them."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if points.max(initial=0) <= np.iinfo(t).max)
    return points.astype(kind)


def _tiles(words: DataFrame) -> DataFrame:
    """Pairs of blocks that can hold near words: (longer, side, i, j, words of both blocks).

    If the longer of two near words has M letters, their common prefix has at least
    h = (M - 1) // 2 or their common suffix at least M - 1 - h. So words of M and M - 1 letters
    are dealt into blocks twice, by their first h and by their last M - 1 - h letters, and
    a block pair without a common beginning or end need not be looked at. A beginning or end
    that many words share fills several blocks, all pairs of which are tiles.
    """
    points = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_POINTS) / F.col("longer")))).cast("long")
    lengths = words.groupBy("length").agg(F.count(F.lit(1)).alias("m"))
    both = lengths.select(F.col("length").alias("longer"), F.col("m").alias("m"), F.lit(True).alias("here")).unionByName(
        lengths.select((F.col("length") + 1).alias("longer"), "m", F.lit(False).alias("here")))
    # One row per word length: no more than there are lengths.
    bins = F.broadcast(both.groupBy("longer").agg(F.sum("m").alias("m"), F.max("here").alias("here")).where("here")
                       .select("longer", F.ceil(F.col("m") / points).alias("bins"), points.alias("size")))
    roles = words.select("word", "n", "length", F.explode(F.array(F.col("length"), F.col("length") + 1)).alias("longer")).join(bins, "longer")
    ends = F.array(F.expr("named_struct('side', 0, 'end', substring(word, 1, CAST(floor((longer - 1) / 2) AS INT)))"),
                   F.expr("named_struct('side', 1, 'end', right(word, CAST(longer - 1 - floor((longer - 1) / 2) AS INT)))"))
    dealt = roles.select("word", "n", "length", "longer", "bins", "size", F.explode(ends).alias("e")).select(
        "word", "n", "length", "longer", "size", F.col("e.side").alias("side"), F.pmod(F.xxhash64("e.end"), F.col("bins")).alias("bin"))
    dealt = materialized(dealt)
    keys = ["longer", "side", "bin"]
    crowded = dealt.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 2 * F.col("size")).select(
        *keys, F.ceil(F.col("m") / F.col("size")).alias("blocks"))
    placed = dealt.join(crowded, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("word", F.lit(7)), F.col("blocks")))
    copies = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return copies.groupBy("longer", "side", "bin", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")).agg(
        F.collect_list(F.struct("word", "n", (F.col("length") == F.col("longer")).alias("long"), "block")).alias("words"))


def _matches(words: list[str], n: np.ndarray, long: np.ndarray, block: np.ndarray, i: int, j: int,
             length: int, side: int) -> list[tuple[str, int, int, str]]:
    """(word, near words, occurrences of the best, the best) of one tile, each near pair in one tile only."""
    head = (length - 1) // 2
    parts = {(b, s): np.flatnonzero((block == b) & (long == s)) for b in {i, j} for s in (True, False)}
    todo = [((i, False), (j, True))] + ([((j, False), (i, True))] if i != j else [])
    mine, theirs = [], []
    for a, b in [((i, True), (j, True)), *todo]:
        a, b = (parts[x] for x in (a, b))
        if not len(a) or not len(b):
            continue
        pa_, pb = _points([words[x] for x in a], len(words[a[0]])), _points([words[x] for x in b], length)
        r, c = np.nonzero(one_edit(pa_, pb, head, side))
        mine.append(a[r])
        theirs.append(b[c])
        if a is not b:
            mine.append(b[c])
            theirs.append(a[r])
    if not mine or not sum(map(len, mine)):
        return []
    mine, theirs = np.concatenate(mine), np.concatenate(theirs)
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[theirs], -n[theirs], mine))
    mine, theirs = mine[order], theirs[order]
    first = np.r_[0, np.flatnonzero(mine[1:] != mine[:-1]) + 1]
    many = np.diff(np.r_[first, len(mine)])
    return [(words[mine[f]], int(m), int(n[theirs[f]]), words[theirs[f]]) for f, m in zip(first, many)]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): how many words are one edit away, and the most frequent of them.

    Of equally frequent ones the smallest in code-point order. Words without any are left out.
    A tile returns one row per word that has a match in it, not its pairs.
    """
    def run(batches):
        for batch in batches:
            out: list[tuple[str, int, int, str]] = []
            for r in range(batch.num_rows):
                length, side, i, j = (batch.column(c)[r].as_py() for c in range(4))
                tile = batch.column(4)[r].values
                flags = [tile.field(k).to_numpy(zero_copy_only=False) for k in ("n", "long", "block")]
                out += _matches(tile.field("word").to_pylist(), *flags, i, j, length, side)
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                             names=["word", "n_near", "near_n", "near"])

    found = _tiles(words).select("longer", "side", "i", "j", "words").mapInArrow(run, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("near_n"), F.col("b.w").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), without circles: each word's form's form, and so on to the last.

    Pointers double: a chain of m steps takes about log2(m) rounds, each a join of the words that have a form.
    """
    now = materialized(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = materialized(now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = 6, often: int = 5, times: int = 5, drop_every: int = DROP_EVERY,
                      name: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of at least ``least`` letters and ``often`` occurrences.

    Near words differ by one inserted, deleted or replaced code point. A word's form is its near
    word with the most occurrences (ties: smallest in code-point order) if that has at least
    ``times`` as many as the word, else null; root follows forms to the last. Repeated rows and
    ids count as often as they occur, null and empty texts have no words, an empty table gives
    no rows, other columns are not looked at.
    """
    counted = word_counts(docs, least, drop_every, name, text).where(F.col("n") >= often)
    words = materialized(counted.withColumn("length", F.length("word")))
    near = near_words(words)
    known: Column = F.col("near_n") >= times * F.col("n")
    judged = materialized(words.join(near, "word", "left").select(
        "word", F.when(known, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(known, F.col("near_n")).alias("form_n")))
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

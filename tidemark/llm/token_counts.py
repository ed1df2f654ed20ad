"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

For BPE the encoding of a text's prefix ends in one token, and what stands before it is the
encoding of the shorter prefix. So a prefix's count is that of the shorter prefix plus one, where
the last token is the only one that fits its predecessor: the two, merged from scratch, stay
two. One pass over a word gives the counts of all its prefixes.
"""
from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate, islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import table_batch
from tidemark.llm.tokens import byte_spelling, per_process

#: The pattern that cuts lower-cased text into words for this vocabulary, and its
#: contractions of three characters, whose first two characters are two words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT_WHEN_CUT = {"'re", "'ve", "'ll"}
END = "</w>"
ASCII_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
NOT_SPACE = re.compile(r"[^ \t\n\r\x0b\x0c]+")
MEMORY = 1_000_000


class Merges:
    """Merge rules of a BPE with word ends, and which neighbours they leave alone."""

    def __init__(self, vocabulary: dict[str, int], merges: Sequence):
        spelling = byte_spelling()
        self.inner: dict[bytes, int] = {}
        self.last: dict[bytes, int] = {}
        for token, i in vocabulary.items():
            plain = token.removesuffix(END)
            if plain and all(c in spelling for c in plain):
                (self.last if plain != token else self.inner)[bytes(spelling[c] for c in plain)] = i
        self.longest = max(map(len, [*self.inner, *self.last]))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = vocabulary[a], vocabulary[b]
            self.rank.setdefault((x, y), r)
            self.parts.setdefault(vocabulary[a + b], (r, x, y))
        self.fit: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        # A token that merging never produces ends no prefix.
        self.inner = {k: t for k, t in self.inner.items() if self.stands(t)}
        self.last = {k: t for k, t in self.last.items() if self.stands(t)}

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """From the token's outermost symbol up to itself: (token, rank of the merge that takes it in)."""
        out: list[tuple[int, float]] = [(token, float("inf"))]
        while token in self.parts:
            r = self.parts[token][0]
            token = self.parts[token][side]
            out.append((token, r))
        return out[::-1]

    def fits(self, a: int, b: int) -> bool:
        """No merge joins the two before each is complete: replays both, in order of rank."""
        if (a, b) not in self.fit:
            left, right = self.spine(a, 2), self.spine(b, 1)
            i = j = 0
            good = True
            while good:
                x, next_x = left[i]
                y, next_y = right[j]
                r = self.rank.get((x, y), float("inf"))
                if r < float("inf") and r < next_x and r <= next_y:
                    good = False
                elif next_x == next_y == float("inf"):
                    break
                elif next_x <= next_y:
                    i += 1
                else:
                    j += 1
            self.fit[a, b] = good
        return self.fit[a, b]

    def stands(self, token: int) -> bool:
        """The token's own text is encoded as this one token."""
        if token not in self.whole:
            if token in self.parts:
                r, x, y = self.parts[token]
                kept = self.rank.pop((x, y))
                self.whole[token] = self.stands(x) and self.stands(y) and self._alone(x, y)
                self.rank[x, y] = kept
            else:
                self.whole[token] = True
        return self.whole[token]

    def _alone(self, x: int, y: int) -> bool:
        self.fit.pop((x, y), None)
        good = self.fits(x, y)
        self.fit.pop((x, y), None)
        return good

    def inside(self, word: bytes) -> tuple[list[int], list[int]]:
        """Last token and count of word[:k], k = 0.., while the word still goes on."""
        n, table, known = len(word), self.inner.get, self.fit.get
        token, count = [-1] * (n + 1), [0] * (n + 1)
        for k in range(1, n + 1):
            for start in range(max(0, k - self.longest), k):
                t = table(word[start:k])
                if t is not None:
                    fits = True if not start else known((token[start], t))
                    if fits or fits is None and self.fits(token[start], t):
                        token[k], count[k] = t, count[start] + 1
                        break
        return token, count

    def ended(self, word: bytes, k: int, token: list[int], count: list[int]) -> int:
        """Count of word[:k] as a whole word: one more than what stands before its last token."""
        for start in range(max(0, k - self.longest), k):
            t = self.last.get(word[start:k])
            if t is not None and (not start or self.fits(token[start], t)):
                return count[start] + 1
        raise ValueError("the vocabulary lacks a byte")


class PrefixCounter:
    """Counts of all prefixes of parts of a text, remembered for parts seen before."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.library = Tokenizer.from_file(path)
        self.merges = Merges(model["vocab"], model["merges"])
        self.words_of = regex.compile(WORDS).finditer
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values() if t.special]
        self.special = re.compile("(" + "|".join(special) + ")") if special else None
        self.words: dict[str, int] = {}
        self.totals: dict[str, int] = {}

    def word(self, word: str) -> list[int]:
        """Counts of all prefixes of a normalised word, by its characters."""
        raw = word.encode()
        state = self.merges.inside(raw)
        ends = range(1, len(raw) + 1) if len(raw) == len(word) else np.cumsum([len(c.encode()) for c in word]).tolist()
        counts = [self.merges.ended(raw, k, *state) for k in ends]
        if word in SPLIT_WHEN_CUT:
            counts[1] = self.word(word[0])[-1] + self.word(word[1])[-1]
        return counts

    def word_total(self, word: str) -> int:
        if word not in self.words:
            raw = word.encode()
            self.words[word] = self.merges.ended(raw, len(raw), *self.merges.inside(raw))
        return self.words[word]

    def part(self, part: str) -> list[int]:
        """Counts of every prefix of a part without ASCII white space, by its characters."""
        pieces = self.special.split(part) if self.special else [part]
        counts, base, total = [], 0, 0
        for k, piece in enumerate(pieces):
            if k % 2:  # a special string is one token once it is complete, plain text before
                got = self._plain(pieces[k - 1] + piece)[len(pieces[k - 1]):]
                counts += [base + c for c in got[:-1]] + [total + 1]
            else:
                counts += [total + c for c in self._plain(piece)]
            base, total = total, counts[-1] if counts else 0
        return counts

    def part_total(self, part: str) -> int:
        pieces = self.special.split(part) if self.special else [part]
        return len(pieces) // 2 + sum(self._plain_total(p) for p in pieces[::2])

    @staticmethod
    def _lowered(piece: str) -> str | None:
        """Lower case, character by character; None where characters grow or join."""
        low = piece.replace("Σ", "σ").lower()
        return low if len(low) == len(piece) and unicodedata.is_normalized("NFC", piece) else None

    def _plain_total(self, piece: str) -> int:
        low = self._lowered(piece)
        if low is None:
            return len(self.library.encode(piece, add_special_tokens=False).ids)
        return sum([self.word_total(m[0]) for m in self.words_of(low)])

    def _plain(self, piece: str) -> list[int]:
        low = self._lowered(piece)
        if low is None:  # every prefix is normalised on its own
            return [len(self.library.encode(piece[:k + 1], add_special_tokens=False).ids) for k in range(len(piece))]
        counts, total, at = [0] * len(piece), 0, 0
        for m in self.words_of(low):
            for k in range(at, m.start()):
                counts[k] = total
            found = self.word(m[0])
            for k, c in enumerate(found, m.start()):
                counts[k] = total + c
            total += found[-1]
            at = m.end()
        for k in range(at, len(piece)):
            counts[k] = total
        return counts

    @staticmethod
    def _odd(text: str) -> bool:
        """Whether the text holds separators that only ``str.split`` takes as white space."""
        return any(c in text for c in "\x1c\x1d\x1e\x1f")

    def split(self, text: str) -> list[str]:
        return [p for p in ASCII_SPACE.split(text) if p] if self._odd(text) else text.split()

    def start(self, text: str, k: int) -> int:
        """Where part ``k`` of a text begins."""
        if self._odd(text):
            return next(islice(NOT_SPACE.finditer(text), k, None)).start()
        return len(text) - len(text.split(None, k)[k]) if k else len(text) - len(text.lstrip())

    def ends(self, text: str) -> tuple[list[str], list[int]]:
        """A text's parts, and the counts of the prefixes that end with each of them."""
        totals, parts = self.totals, self.split(text)
        for p in set(parts).difference(totals):
            totals[p] = self.part_total(p)
        return parts, list(accumulate(map(totals.__getitem__, parts)))

    def total(self, text: str) -> int:
        return (self.ends(text)[1] or [0])[-1]

    def all(self, text: str) -> list[int]:
        """Counts of every prefix of a text, by its characters."""
        out, total = [0] * len(text), 0
        at = 0
        for m in NOT_SPACE.finditer(text):
            out[at:m.start()] = [total] * (m.start() - at)
            found = self.part(m[0])
            out[m.start():m.end()] = [total + c for c in found]
            total += found[-1]
            at = m.end()
        out[at:] = [total] * (len(text) - at)
        return out

    def within(self, text: str, parts: list[str], ends: list[int], budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens, from ``ends(text)``.

        Counts at the ends of parts never fall, so a binary search finds the part that goes
        beyond; only that part's own prefixes are asked.
        """
        k = bisect_right(ends, budget)
        if k == len(ends):
            return len(text)
        start = self.start(text, k)
        left = budget - (ends[k - 1] if k else 0)
        return start + max((j for j, c in enumerate(self.part(parts[k]), 1) if c <= left), default=0)

    def fit(self, text: str, budget: int) -> int:
        return self.within(text, *self.ends(text), budget)

    def forget(self) -> None:
        for known in (self.words, self.totals, self.merges.fit):
            if len(known) > MEMORY:
                known.clear()


def counter(path: str) -> PrefixCounter:
    return per_process(f"prefix:{path}", lambda: PrefixCounter(path))


def _texts(docs: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))


def _mapped(docs: DataFrame, path: str, keep: Sequence[str], text: str, fields: str, fn) -> DataFrame:
    from pyspark.sql.types import StructType

    taken = _texts(docs, keep, text)
    schema = StructType([taken.schema[i] for i in range(len(keep))] + list(StructType.fromDDL(fields)))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, count = to_arrow_schema(schema), counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                count.forget()
                rows = [fn(count, t) for t in part.column(len(keep)).to_pylist()]
                yield table_batch([part.column(i) for i in range(len(keep))] + [list(c) for c in zip(*rows)], arrow)

    return taken.mapInArrow(run, schema)


def prefix_counts(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and counts: tokens of the text's first 1, 2, ... characters.

    No begin, end or added tokens; special strings inside a text count one token once they are
    complete. A null or empty text has an empty array; white space adds nothing.
    """
    return _mapped(docs, path, keep, text, "counts array<int>", lambda c, t: (c.all(t),))


def tokens_of_prefix(counts: Column, chars: Column) -> Column:
    """Token count of the first ``chars`` characters, from stored counts."""
    return F.when(chars <= 0, F.lit(0)).otherwise(F.get(counts, F.least(chars, F.size(counts)).cast("int") - 1))


def longest_prefix(counts: Column, budget: Column) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens, from stored counts."""
    return F.coalesce(F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i + 1))), F.lit(0))


def token_counts(docs: DataFrame, path: str, limit: int, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep``, n_bytes (UTF-8), n_tokens, over_limit, fit_chars (characters of the
    longest prefix with at most ``limit`` tokens). Null texts count as empty; rows stay rows.

    A text's prefix counts are made once, at the ends of its parts, which are kept until its row
    is answered: n_tokens is the last of them, and the limit falls into the part that a binary
    search over them finds. ``prefix_counts`` keeps the counts of all prefixes.
    """
    def fn(count: PrefixCounter, t: str):
        parts, ends = count.ends(t)
        n = ends[-1] if ends else 0
        return len(t.encode()), n, n > limit, count.within(t, parts, ends, limit)

    return _mapped(docs, path, keep, text, "n_bytes long, n_tokens long, over_limit boolean, fit_chars long", fn)

"""Token ids of whole texts by a byte-level BPE file, with a bounded memory of words."""
from __future__ import annotations

import re
import sys
import types
from array import array

#: A single space between two other characters: no token of a byte-level BPE reaches across it.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the space and the newline.
OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
ODD = ["  ", " \n", "\n ", *OTHER_SPACES]
#: Fixed value: the public pattern that cuts text into words for this kind of vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMORY = 300_000


def per_process(key: str, make):
    """An object that a Python worker keeps from task to task."""
    store = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def byte_spelling() -> dict[str, int]:
    """Byte value of each character that byte-level vocabularies spell bytes with: printable
    Latin-1 characters stand for themselves, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class ByteEncoder:
    """Ids of a text as packed little-endian 32-bit numbers.

    A text is cut at single spaces. Parts are remembered, and so are the words they are made
    of; only new words are encoded, by the tiktoken library from the same vocabulary file. The
    result is what the tokenizers library gives for the whole text, special strings included:
    they hold no space, and parts with one go to that library as they are.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words_of = regex.compile(WORDS).findall
        spelling = byte_spelling()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = {bytes(map(spelling.__getitem__, t)): i for t, i in vocabulary.items() if t not in self.special}
        self.encode_word = tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}  # parts at the start of a text
        self.later: dict[str, bytes] = {}  # parts behind a space

    def _word(self, word: str, new: list[str]) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            special = any(s in word for s in self.special)
            found = self.library.encode(word, add_special_tokens=False).ids if special else self.encode_word(word)
            ids = self.words[word] = array("I", found).tobytes()
            new.append(word)
        return ids

    def _learn(self, parts: list[str], known: dict[str, bytes], lead: str) -> list[str]:
        """Adds the ids of new parts to ``known``; the words that were new."""
        word, new = self._word, []
        for p in parts:
            if p.isalpha():  # one word
                known[p] = word(lead + p, new)
            elif p[-1:] in (".", ",") and p[:-1].isalpha():
                known[p] = word(lead + p[:-1], new) + word(p[-1], new)
            elif any(s in p for s in self.special):
                known[p] = word(lead + p, new)
            else:
                known[p] = b"".join([word(w, new) for w in self.words_of(lead + p)])
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = []
        for text in texts:
            odd = text[:1] == " " or text[-1:] == " " or any(s in text for s in ODD)
            parts.append(CUT.split(text) if odd else text.split(" "))
        first = [p.pop(0) for p in parts]
        starts, rest = list(set(first).difference(self.first)), list(set().union(*parts).difference(self.later))
        new = self._learn(starts, self.first, "") + self._learn(rest, self.later, " ")
        later = self.later.__getitem__
        out = [self.first[f] + b"".join(map(later, p)) for f, p in zip(first, parts)]
        # A full memory keeps what it knows, the frequent parts, and forgets the newest.
        for known, recent in ((self.words, new), (self.first, starts), (self.later, rest)):
            if len(known) > MEMORY:
                for x in recent:
                    del known[x]
        return out


def encoder(path: str) -> ByteEncoder:
    return per_process(f"byte:{path}", lambda: ByteEncoder(path))

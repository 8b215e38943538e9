"""BPE encoding and decoding with a public vocabulary of word pieces.

A word is a doubly linked list of symbols; a heap holds the possible merges by rank and place.  An entry whose
symbols have changed since is stale and skipped.  Words repeat, so each task keeps the results of
the words it has seen in a bounded table.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Words whose results a task keeps: the last so many, and those among as many before that are asked for again.
CACHED_WORDS = 60_000
#: Rows that a task hands back at once.
ROWS = 256
#: Longer words are not kept.
CACHED_LENGTH = 64
#: White space of Unicode; unlike str.split() without the separators U+001C to U+001F.
_SPACE = regex.compile(r"[\t-\r\x20\x85\xa0  -     　]+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


_BYTE_LETTERS = dict(enumerate(byte_letters()))
_LATIN = regex.compile("[\x21-\x7e\xc0-\xff]+")
#: What keeps a line from being read in one go: anything but ASCII white space, printable ASCII and Latin-1 letters.
_OTHER = re.compile("[^\t-\r\x20-\x7e\xc0-\xff]")


class Kept(dict):
    """A bounded table; when full it becomes the older one, from which a value asked for again comes back."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict = {}

    def recall(self, key):
        """The value of a key that the table itself lacks, or None."""
        if (value := self.older.get(key)) is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        self[key] = value


class Bpe:
    """The vocabulary, merges, pattern and special tokens of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        letters = byte_letters()
        self.inner = {c: vocab.get(c) for c in letters}
        self.final = {c: vocab.get(c + self.suffix) for c in letters}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: Rank of each pair of symbols, and what the merge of that rank makes.
        self.ranks, self.made = {}, []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.rules = Tokenizer.from_file(path)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(pattern)
        self.latin_word = re.compile(_spelled_out(pattern))
        self.shown = {i: s.encode() for i, s in self.strings.items()}
        self.seen = Kept()
        self.words = Kept()

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge the pair of the lowest rank, at equal rank the leftmost, until none is left."""
        rank_of, made_of, n = self.ranks.get, self.made, len(symbols)
        # The rank, if any, of the pair that starts at each place; an entry is rank and place in one number.
        ranks = list(map(rank_of, zip(symbols, symbols[1:])))
        width = n.bit_length()
        heap = [rank << width | i for i, rank in enumerate(ranks) if rank is not None]
        if not heap:
            return symbols
        pop, push, places = heapq.heappop, heapq.heappush, (1 << width) - 1
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks.append(None)
        while heap:
            entry = pop(heap)
            i = entry & places
            rank = entry >> width
            if ranks[i] != rank:
                continue  # stale
            made, j = made_of[rank], after[i]
            symbols[i], symbols[j] = made, -1
            ranks[i] = ranks[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of((made, symbols[k]))) is not None:
                    ranks[i] = rank
                    push(heap, rank << width | i)
            if (h := before[i]) >= 0:
                ranks[h] = rank = rank_of((symbols[h], made))
                if rank is not None:
                    push(heap, rank << width | h)
        return [s for s in symbols if s >= 0]

    def _words(self, chunk: str) -> list[str]:
        """The words of a chunk in byte letters.  Printable ASCII letters stand for themselves, and Latin-1 letters have one lower
        case; what is lower case or a letter elsewhere depends on the edition of Unicode, so the library's own rules are asked."""
        if chunk.isascii() and chunk.isprintable():
            return self.word.findall(chunk.lower())
        if _LATIN.fullmatch(chunk):
            return [word.encode().decode("latin-1").translate(_BYTE_LETTERS) for word in self.word.findall(chunk.lower())]
        whole = self.rules.normalizer.normalize_str(chunk)
        return [word for word, _ in self.rules.pre_tokenizer.pre_tokenize_str(whole)]

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids as bytes and their strings, of text without white space that ``seen`` lacks."""
        if found := self.seen.recall(chunk):
            return found
        words = [self._word(letters) for letters in self._words(chunk)]
        found = _joined([w for w in words if w[0]])
        if len(chunk) <= CACHED_LENGTH:
            self.seen.keep(chunk, found)
        return found

    def _word(self, letters: str) -> tuple[bytes, bytes]:
        """Chunks differ in case and marks more than their words do, so words are kept by themselves."""
        return self.words.get(letters) or self._new_word(letters, letters)

    def _latin(self, word: str) -> tuple[bytes, bytes]:
        """A word of a line in ASCII and Latin-1 letters that ``words`` lacks; it never reads as the byte letters of another."""
        if word.isascii():
            return self._new_word(word, word)
        letters = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return self._new_word("\n" + word, letters)

    def _new_word(self, key: str, letters: str) -> tuple[bytes, bytes]:
        if known := self.words.recall(key):
            return known
        symbols = [self.inner[c] for c in letters[:-1]] + [self.final[letters[-1]]]
        ids = self.merge([s for s in symbols if s is not None])
        known = (_packed(ids), b" ".join([self.shown[i] for i in ids]))
        if len(key) <= CACHED_LENGTH:
            self.words.keep(key, known)
        return known

    def _parts(self, text: str) -> list[tuple[bytes, bytes]]:
        if "<" in text and self.marks.search(text):
            found: list[tuple[bytes, bytes]] = []
            for part in self.marks.split(text):
                if (mark := self.special.get(part)) is not None:
                    found.append((_packed([mark]), part.encode()))
                else:
                    found += self._parts(part)
            return found
        if _OTHER.search(text) is None:
            return self._latin_parts(text)
        found = []
        for line in text.split("\n"):
            found += self._latin_parts(line) if _OTHER.search(line) is None else self._chunks(line)
        return found

    def _latin_parts(self, text: str) -> list[tuple[bytes, bytes]]:
        known, made = self.words.get, self._latin
        return [known(w if w.isascii() else "\n" + w) or made(w) for w in self.latin_word.findall(text.lower())]

    def _chunks(self, text: str) -> list[tuple[bytes, bytes]]:
        chunks = filter(None, _SPACE.split(text)) if _SEPARATORS.search(text) else text.split()
        seen, made = self.seen.get, self._chunk
        return [seen(chunk) or made(chunk) for chunk in chunks]

    def packed(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        return _joined([p for p in self._parts(text) if p[0]])

    def encode(self, text: str) -> tuple[bytes, str, int]:
        """Ids as little-endian unsigned 32-bit integers, the decoded text, and the number of ids."""
        ids, decoded = self.packed(text)
        return ids, decoded.decode(), len(ids) // 4

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, joined by a space: the tokenizer names no decoder."""
        return " ".join([self.strings[i] for i in ids])


def _spelled_out(pattern: str) -> str:
    """``pattern`` for text of ASCII white space, printable ASCII and Latin-1 letters in lower case, with the classes
    of Unicode as lists of characters; the plain module for regular expressions is twice as fast."""
    plain = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x100)]]
    for name in ("L", "N"):
        members = "".join(re.escape(c) for c in plain if regex.match(rf"\p{{{name}}}", c))
        pattern = pattern.replace(rf"\p{{{name}}}", members)
    return pattern


def _joined(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    return b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts])


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


@functools.lru_cache(maxsize=1)
def _loaded(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, unless left out, ``ids``.

    ``path``: a tokenizer file that every executor can open.  Null and empty texts have no tokens; a text is encoded whole
    in any length; the strings of special tokens in a text become those tokens.  Repeated rows have equal results; an
    empty table gives no rows; other columns are not read.
    """
    kind = "struct<n:bigint,ids_sha256:string,decoded_sha256:string" + (",ids:array<int>>" if keep_ids else ">")

    @F.pandas_udf(kind)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _loaded(path)
        names = ["n", "ids_sha256", "decoded_sha256", "ids"][: 4 if keep_ids else 3]
        for batch in texts:
            # In short frames: the ids of a whole batch, and their copies on the way out, would fill more memory than the model.
            for start in range(0, max(len(batch), 1), ROWS):
                rows = []
                for t in batch.iloc[start : start + ROWS]:
                    ids, decoded = model.packed(t or "")
                    row = (len(ids) // 4, sha256(ids).hexdigest(), sha256(decoded).hexdigest())
                    rows.append((*row, np.frombuffer(ids, "<i4")) if keep_ids else row)
                yield pd.DataFrame(rows, columns=names)

    done = docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("r"))
    more = [F.col("r.ids").alias("ids")] if keep_ids else []
    return done.select("doc_id", F.col("r.n").alias("n_tokens"), "r.ids_sha256", "r.decoded_sha256", *more)

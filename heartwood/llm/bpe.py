"""Byte-pair encoding by tree concatenation, and decoding.

A text longer than HALF characters is halved, wherever that falls, until its parts are not; all parts are encoded by
themselves, and then, level by level, neighbours are joined: a window around the join is read again, from the last word of the
left part that can't depend on what follows, and grows to the right until a word starts at the same place in the window and in
the right part. What stands before that place is the window's, what follows is the right part's. A pre-tokenizer reads from
left to right and sees LOOK characters ahead at most, so that from a common start on both readings are one.

Inside a word, merges leave no blank to start from. A word of more than LEAF symbols is a tree too: its leaves are encoded
without the end-of-word mark unless they end it, and windows of tokens grow on both sides of each join until the first token
equals the left half's token there and the last one the right half's. Then every pair of neighbouring tokens stands in some
encoding made by the merges themselves, which makes the whole sequence the one that the merges give. A word that a join of two
parts puts together of a word of each comes from their encodings in the same way, so that a long text without a blank isn't
encoded again at each level.

Encodings of words are kept and used again. Null texts count as empty; empty texts have no ids and decode to the empty
string. Equal texts have equal ids, whatever batch they are in.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, text_or_empty

TOKENIZER = "word_bpe_49k.json"
HALF = 1024
LEAF = 48
WINDOW = 4
#: Characters that the choice of a word's pattern depends on: those of the longest contraction.
LOOK = 3
BLANK = " \t\n\r"
KEPT_WORDS = 200_000

#: Texts of these characters only are cut with the regex library; others by the tokenizer's own normalizer and pre-tokenizer.
ODD = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")


#: A word's of_word, or the ids of a long one that grows from join to join.
Encoded = tuple[int, str, str] | list[int]
#: Start and end in a text, its words encoded, and where each of them starts.
Part = tuple[int, int, list[Encoded], list[int]]


class TreeBPE:
    """The encoder and decoder of one tokenizer file."""

    def __init__(self, name: str = TOKENIZER, leaf: int = LEAF, half: int = HALF):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, models

        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.leaf, self.half = max(2, leaf), max(1, half)
        self.joins = 0  # of parts of texts, since it was set to 0
        self.whole = self.tokenizer.model
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)  # words that go on: no end-of-word mark
        self.suffix = model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = added
        self.cut_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        # Fixed value: the tokenizer's own pattern of words.
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.symbol = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(printable))}
        self.words: dict[str, tuple[int, str, str]] = {}

    def normal(self, text: str) -> tuple[str, bool]:
        """The normalized text, and if its words are the tokenizer's own pre-tokenizer's to find."""
        if ODD.search(text):
            return self.tokenizer.normalizer.normalize_str(text), True
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower(), False

    def symbols(self, word: str) -> str:
        return word if word.isascii() else "".join(map(self.symbol.__getitem__, word.encode()))

    def cut(self, text: str, odd: bool) -> list[str]:
        """The words of a normalized text, in the tokenizer's byte symbols."""
        if odd:
            return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        found = self.word.findall(text)
        return found if text.isascii() else [self.symbols(w) for w in found]

    def scan(self, text: str, odd: bool, start: int, end: int) -> list[tuple[int, str]]:
        """(start, word) of the words of text[start:end]."""
        part = text[start:end]
        if odd:
            return [(start + s, w) for w, (s, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return [(start + m.start(), self.symbols(m[0])) for m in self.word.finditer(part)]

    def leaves(self, part: str, last: bool) -> list[int]:
        return [t.id for t in (self.whole if last else self.inner).tokenize(part)] if part else []

    def length(self, token: int) -> int:
        """Symbols of a token."""
        t = self.token[token]
        return len(t) - len(self.suffix) if self.suffix and t.endswith(self.suffix) else len(t)

    def join_words(self, word: str, middle: int, left: list[int], right: list[int], last: bool) -> list[int]:
        """Encoding of word from those of word[:middle] and word[middle:]."""
        k = WINDOW
        while True:
            a, b = left[-k:], right[:k]
            start = middle - sum(map(self.length, a))
            end = middle + sum(map(self.length, b))
            at_start, at_end = k >= len(left), k >= len(right)
            ids = self.leaves(word[start:end], last and at_end)
            if at_start and at_end:
                return ids
            if (at_start or ids[0] == a[0]) and (at_end or ids[-1] == b[-1]):
                return left[: len(left) - len(a)] + ids + right[len(b) :]
            k *= 2

    def tree(self, word: str) -> list[int]:
        """Encoding of a word by halves, from the leaves up."""
        spans = [(s, min(s + self.leaf, len(word))) for s in range(0, len(word), self.leaf)]
        level = [(s, e, self.leaves(word[s:e], e == len(word))) for s, e in spans]
        while len(level) > 1:
            joined = [
                (s, e, self.join_words(word[s:e], m - s, left, right, e == len(word)))
                for (s, m, left), (_, e, right) in zip(level[::2], level[1::2])
            ]
            level = joined + level[len(joined) * 2 :]
        return level[0][2]

    def told(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids))

    def of_word(self, word: str) -> tuple[int, str, str]:
        """(number of ids, the ids with spaces between, the tokens they decode to with spaces between) of a word."""
        out = self.told(self.tree(word))
        if len(word) <= 2 * self.leaf:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = out
        return out

    def join(self, text: str, odd: bool, left: Part, right: Part) -> Part:
        """The part that two neighbouring parts of a normalized text make."""
        self.joins += 1
        (first, middle, before, starts), (_, end, after, at_right) = left, right
        if not starts or text[middle - 1] in BLANK or text[middle] in BLANK:
            return first, end, before + after, starts + at_right
        # The left part's last words may read otherwise; a word is sure to start where all before it saw no further than middle.
        i = max(0, bisect_right(starts, middle - LOOK) - 1)
        k = (at_right[1] if len(at_right) > 1 else end) - middle + WINDOW
        while True:
            to = min(middle + k, end)
            window = self.scan(text, odd, starts[i] if i else first, to)
            places = {at: j for j, at in enumerate(at_right[: bisect_right(at_right, to)])}
            same = next((j for j, (at, _) in enumerate(window) if at in places and (at <= to - LOOK or to == end)), None)
            if same is not None or to == end:
                break
            k *= 2
        follows = len(at_right) if same is None else places[window[same][0]]
        words = window[:same]
        return first, end, before[:i] + self.between(text, words, middle, left, right, follows) + after[follows:], starts[:i] + [at for at, _ in words] + at_right[follows:]

    def between(self, text: str, words: list[tuple[int, str]], middle: int, left: Part, right: Part, follows: int) -> list[Encoded]:
        """The words of a window around middle, encoded. A long one that the join has put together of one word on each
        side comes from these two's encodings."""
        (_, _, before, starts), (_, _, after, at_right) = left, right
        out = []
        for at, word in words:
            j = bisect_left(starts, at)
            if len(word) > 2 * self.leaf and at < middle and (at, word) == words[-1] and follows == 1 and at_right[0] == middle and j == len(starts) - 1 and starts[j] == at:
                halves = [w if isinstance(w, list) else [int(x) for x in w[1].split(" ")] for w in (before[j], after[0])]
                out.append(self.join_words(word, len(self.symbols(text[at:middle])), *halves, True))
            else:
                out += self.encoded([word])
        return out

    def encoded(self, words: Iterable[str]) -> list[tuple[int, str, str]]:
        kept = self.words
        return [kept.get(w) or self.of_word(w) for w in words]

    def part(self, text: str, odd: bool, start: int, end: int, whole: bool) -> Part:
        if whole:  # nothing is joined to it
            return start, end, self.encoded(self.cut(text, odd)), []
        found = self.scan(text, odd, start, end)
        return start, end, self.encoded(w for _, w in found), [at for at, _ in found]

    def of_text(self, text: str) -> list[tuple[int, str, str]]:
        """of_word of every word of a text without special tokens, by halves."""
        text, odd = self.normal(text)
        number = 1
        while len(text) > number * self.half:
            number *= 2
        bounds = [len(text) * i // number for i in range(number + 1)]
        level = [self.part(text, odd, s, e, number == 1) for s, e in zip(bounds, bounds[1:])]
        while len(level) > 1:
            level = [self.join(text, odd, a, b) for a, b in zip(level[::2], level[1::2])]
        return [self.told(w) if isinstance(w, list) else w for w in level[0][2]]

    def encode(self, text: str) -> list[tuple[int, str, str]]:
        """of_word of every word and special token of a text, in order."""
        out = []
        for part in self.cut_special.split(text) if self.cut_special and "<|" in text else (text,):
            if part in self.special:
                i = self.special[part]
                out.append((1, str(i), self.token[i]))
            elif part:
                out += self.of_text(part)
        return out

    def ids(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.encode(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Tokens with spaces between, special ones too: this tokenizer has no decoder of its own."""
        return " ".join(self.token[i] for i in ids)


@lru_cache(2)
def encoder(name: str = TOKENIZER, leaf: int = LEAF) -> TreeBPE:
    return TreeBPE(name, leaf)


def encode_texts(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids (array) and decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer, leaf)
        for b in batches:
            ids = [bpe.ids(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return mapped(df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text")), run, "doc_id long, ids array<int>, decoded string")


def encoding_digest(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_joins (of parts of the text): the ids and the decoded text are
    hashed in the task that makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer, leaf)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            n, ids, decoded, joins = [], [], [], []
            for t in b.column(1).to_pylist():
                bpe.joins = 0
                parts = bpe.encode(t)
                joins.append(bpe.joins)
                n.append(sum(p[0] for p in parts))
                ids.append(sha(" ".join([p[1] for p in parts])))
                decoded.append(sha(" ".join([p[2] for p in parts])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(joins, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_joins"])

    return mapped(df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins long")

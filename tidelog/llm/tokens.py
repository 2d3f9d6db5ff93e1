"""Byte-level BPE of the byte_bpe_50k vocabulary: words, ids and counts.

A text is cut at the special string, then into words by the vocabulary's pattern. Texts of Latin
letters only go through an equal pattern of Python's re, which is faster than Unicode classes; any
other text is cut by the tokenizers library itself. Each distinct word is worked out once and kept
in a table of bounded size; the words of a language repeat.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np

MAX_KEPT = 400_000
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
SPACES = r"\t-\r \x85\xa0"
#: The vocabulary's pattern where all characters are below U+0250 and none is a non-ASCII number.
FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^{SPACES}{LETTERS}0-9]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
OTHER = re.compile("[²³¹¼-¾ɐ-\U0010ffff]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: the vocabulary's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Words:
    """Cuts texts into words; special strings are words of their own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = json.loads(self.tokenizer.to_str())
        if self.model["normalizer"] is not None or self.model["model"]["type"] != "BPE":
            raise ValueError(f"{path}: only byte-pair vocabularies without a normaliser are supported")
        #: Whether FAST and PATTERN are the file's own way to cut words.
        self.usual = _is_usual(self.model["pre_tokenizer"])
        self.special = {x["content"]: x["id"] for x in self.model["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def cut(self, text: str) -> list[str]:
        if self.at_special and any(s in text for s in self.special):
            out = []
            for piece in self.at_special.split(text):
                out += [piece] if piece in self.special else self.plain(piece)
            return out
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if self.usual and OTHER.search(text) is None:
            return FAST.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def _is_usual(pre: dict | None) -> bool:
    return bool(pre) and pre["type"] == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


def _by_rank(model: dict, special: dict[str, int]) -> bool:
    """Whether merging by the lowest id of a pair is merging in the order of the file's merges."""
    if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    ids = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    long = {i for t, i in model["vocab"].items() if len(t) > 1 and t not in special}
    return None not in ids and all(a < b for a, b in zip(ids, ids[1:])) and long == set(ids)


class Ids(Words):
    """encode(text): the library's ids as bytes, little-endian unsigned 32-bit. The same vocabulary and
    pattern in tiktoken give the same ids several times faster; it takes the texts that the fast
    pattern may take, and the tokenizers library all others. A vocabulary with another pattern, or whose
    ids aren't in the order of its merges, goes through the library altogether."""

    def __init__(self, path: str):
        super().__init__(path)
        self.fast = None
        if not self.usual or not _by_rank(self.model["model"], self.special):
            return
        import tiktoken

        byte = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in self.model["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is not None and OTHER.search(text) is None and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Counts(Words):
    """count(text): how many ids the text has, without making any. Per word: a heap of the adjacent
    pairs by merge rank over a linked list of symbols; the count is symbols less merges."""

    def __init__(self, path: str):
        super().__init__(path)
        letters = _byte_letters()
        self.letter = {b: letters[b] for b in range(256)}
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(self.model["model"]["merges"])}
        self.kept: dict[str, int] = {s: 1 for s in self.special}

    def count(self, text: str) -> int:
        words = self.cut(text)
        try:
            return sum(map(self.kept.__getitem__, words))
        except KeyError:
            pass
        if len(self.kept) > MAX_KEPT:
            self.kept = {s: 1 for s in self.special}
        for w in words:
            if w not in self.kept:
                self.kept[w] = self.word(w)
        return sum(map(self.kept.__getitem__, words))

    def word(self, word: str) -> int:
        symbols: list[str | None] = [self.letter[b] for b in word.encode()]
        n = len(symbols)
        if n < 2:
            return n
        rank, following, before = self.rank, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = following[i]
            if symbols[i] != pair[0] or j >= n or symbols[j] != pair[1]:
                continue  # a neighbour was merged meanwhile
            symbols[i], symbols[j] = pair[0] + pair[1], None
            following[i] = k = following[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank.get(p := (symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, p))
            if (h := before[i]) >= 0 and (r := rank.get(p := (symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, p))
        return left


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the other bytes for
    the letters from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    table = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


_made: dict[tuple[type, str], Words] = {}


def made(kind: type, path: str):
    """One of a kind in each Python worker."""
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]

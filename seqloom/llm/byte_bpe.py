"""Byte-level BPE: ranks, word splitting and cached encoding that other operators use.

Text is cut into the matches of the public pattern. Where no two white-space characters are
adjacent, every space starts a match and every newline is one, so words can be looked up by plain
string splitting; texts with adjacent white space take the pattern itself. Both give the same
matches (tests compare them).
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import public_tokenizers
import regex

#: Entries that a word cache holds before it stops growing: bounds a worker's memory.
CACHE_WORDS = 800_000

_ADJACENT = re.compile(r"\s\s")
_BEYOND = re.compile("[^\x00-\u024f\u2010-\u2027]")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def pattern(text: str = public_tokenizers.PATTERN):
    return regex.compile(text)


def chunks(text: str) -> list[str]:
    """Pieces of ``text`` that are unions of whole matches; joined they are the text."""
    if "\x00" in text or _ADJACENT.search(text):
        return pattern().findall(text)
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")


class Words(dict):
    """word -> made(word), kept for recent words: at ``limit`` the older half goes."""

    def __init__(self, made: Callable[[str], object], limit: int = CACHE_WORDS):
        super().__init__()
        self.made, self.half, self.old = made, limit // 2, {}

    def __missing__(self, word: str):
        out = self.old.get(word)
        if out is None:
            out = self.made(word)
        if len(word) <= 64:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


@lru_cache(maxsize=4)
def rust_encoding(path: str, pat: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def library_encoder(ranks_path: str, json_path: str) -> Callable[[str], list[int]]:
    """text -> the ids that ``tokenizers`` gives with the JSON file.

    Texts of Latin letters go through the rank file, whose vocabulary is the same, and without
    adjacent white space through a pattern that needs no look-ahead; others, where two libraries
    could class a character differently, and those that hold an added token (such as
    ``<|endoftext|>``, which gets its one id), through ``tokenizers`` itself.
    """
    full = public_tokenizers.PATTERN
    plain = rust_encoding(ranks_path, full.replace(r"\s+(?!\S)|\s+", r"\s"))._core_bpe.encode_ordinary
    whole = rust_encoding(ranks_path, full)._core_bpe.encode_ordinary
    with open(json_path, "rb") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", ())]
    slow = []

    def encode(text: str) -> list[int]:
        if (not text.isascii() and _BEYOND.search(text)) or any(a in text for a in added):
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(json_path))
            return slow[0].encode(text, add_special_tokens=False).ids
        return whole(text) if _ADJACENT.search(text) else plain(text)

    return encode


# Encoding by prefix dynamic programming


class PrefixEncoder:
    """Encoder that stores, for each byte prefix, the one valid last token of its encoding.

    A sequence of tokens is what the merges yield exactly if every token yields itself and every
    neighbouring pair yields itself. So the last token of each prefix is the one that ends there,
    and forms such a pair with the last token of the prefix before it. The table of a prefix never
    changes when bytes follow: appending extends the table, and an edit needs a new table from the
    edited byte on, only as far as both tables agree again.
    """

    def __init__(self, ranks: dict[bytes, int], pair_limit: int = 400_000, prefix_limit: int = 600_000):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.sizes = {v: len(k) for k, v in ranks.items()}
        self.good = {k: v for k, v in ranks.items() if self.merge(k) == [v]}  # tokens that yield themselves
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[int, bool] = {}
        self.prefixes: dict[bytes, int] = {}  # prefix of some match -> last token; shared by all matches
        self.pair_limit, self.prefix_limit = pair_limit, prefix_limit

    def merge(self, piece: bytes) -> list[int]:
        """The merges carried out one by one, lowest rank first: the definition, used for short pieces."""
        get, none = self.ranks.get, len(self.ranks) + (1 << 30)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (best := min(pairs)) != none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def is_pair(self, a: int, b: int) -> bool:
        key = a << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
            if len(self.pairs) < self.pair_limit:
                self.pairs[key] = ok
        return ok

    def fits(self, a: int, b: int) -> bool:
        ok = self.pairs.get(a << 32 | b)
        return self.is_pair(a, b) if ok is None else ok

    def extend(self, piece: bytes, last: list[int], start: int, stop: int | None = None) -> None:
        """Fill ``last`` (the last token of each prefix, by its length less one) for prefixes over ``start`` bytes."""
        get, longest, pairs = self.good.get, self.longest, self.pairs
        for end in range(start + 1, (len(piece) if stop is None else stop) + 1):
            for begin in range(max(0, end - longest), end):
                token = get(piece[begin:end])
                if token is None:
                    continue
                if begin:
                    before = last[begin - 1]
                    ok = pairs.get(before << 32 | token)
                    if not (self.is_pair(before, token) if ok is None else ok):
                        continue
                last.append(token)
                break
            else:
                raise ValueError(f"no token ends at byte {end} of {piece[:40]!r}")

    def walk(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the prefix of ``end`` bytes, from its last token backwards."""
        out, at = [], len(last) if end is None else end
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[out[-1]])
        return out[::-1]

    def table(self, piece: bytes) -> list[int]:
        last: list[int] = []
        self.extend(piece, last, 0)
        return last

    def append(self, piece: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The table of ``piece + more``; work only on ``more``."""
        whole, out = piece + more, list(last)
        self.extend(whole, out, len(piece))
        return whole, out

    def edit(self, piece: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int], int]:
        """The table after ``piece[start:stop]`` became ``new``, and how many prefixes were computed anew.

        A last token depends on the bytes and the table at most ``longest`` back. So behind the edit,
        once that many prefixes in a row have the last tokens that they had, the rest of the table holds.
        """
        whole, out, shift = piece[:start] + new + piece[stop:], last[:start], len(new) - (stop - start)
        same = 0
        for end in range(start + 1, len(whole) + 1):
            self.extend(whole, out, end - 1, end)
            old = end - shift
            same = same + 1 if end > start + len(new) and last[old - 1] == out[-1] else 0
            if same >= self.longest:
                return whole, out + last[old:], end - start
        return whole, out, len(whole) - start

    def encode(self, piece: bytes) -> list[int]:
        """One match of the pattern; a match that is itself a token stays whole.

        Matches share the stored prefixes: only bytes behind the longest stored one take work.
        """
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        n = len(piece)
        if n > 64:
            return self.walk(self.table(piece))
        known, get, pairs, sizes, at = self.prefixes, self.good.get, self.pairs, self.sizes, n
        if len(known) >= self.prefix_limit:
            known.clear()
        while at and piece[:at] not in known:
            at -= 1
        last = [known[piece[:i]] for i in range(1, at + 1)]
        begin = at - sizes[last[-1]] if at else 0  # where the token before starts: the next one often starts there too
        for end in range(at + 1, n + 1):
            token = get(piece[begin:end])
            if token is None or (begin and not self.fits(last[begin - 1], token)):
                for begin in range(end - 1, -1, -1):
                    token = get(piece[begin:end])
                    if token is None:
                        continue
                    if not begin:
                        break
                    ok = pairs.get(last[begin - 1] << 32 | token)
                    if self.is_pair(last[begin - 1], token) if ok is None else ok:
                        break
                else:
                    raise ValueError(f"no token ends at byte {end} of {piece!r}")
                if token is None:
                    raise ValueError(f"no token ends at byte {end} of {piece!r}")
            last.append(token)
            known[piece[:end]] = token
        out = []
        while n:
            token = last[n - 1]
            out.append(token)
            n -= sizes[token]
        return out[::-1]

    def encode_text(self, text: str) -> list[int]:
        return [t for m in pattern().findall(text) for t in self.encode(m.encode("utf-8", "replace"))]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def prefix_encoder(ranks_path: str) -> PrefixEncoder:
    return PrefixEncoder(load_ranks(ranks_path))


def one_match(word: str) -> bool:
    """Letters only, perhaps behind a space: the pattern takes such a word whole."""
    return word[1:].isalpha() and (word[0] == " " or word[0].isalpha())


@lru_cache(maxsize=2)
def id_words(ranks_path: str) -> Words:
    """word -> its ids by prefix dynamic programming, of each match of the pattern in it."""
    enc, find = prefix_encoder(ranks_path), pattern().findall
    matches = Words(lambda m: enc.encode(m.encode("utf-8", "replace")))

    def made(word: str) -> list[int]:
        if one_match(word):
            return matches[word]
        return [t for m in find(word) for t in matches[m]]

    return Words(made)

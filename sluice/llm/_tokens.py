"""Token ids of whole texts by the tokenizers library, at the price of one library call per distinct word.

The vocabulary splits a text before every run of white space that follows another character, so a text may be cut there and each piece encoded
alone. Pieces of many texts are cut, hashed and looked up together, in arrays, in a bounded table of the pieces that a worker has met, by all their bytes. A new piece that
is a word of Latin letters, with a line end before it or signs after it, is one word to the library's BPE model; any other is
encoded by the library as it is. Texts with white space outside ASCII go to the library whole, as the cut would not be safe.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np

_SPACE = r" \t\n\r\f\v"
#: Other code points that some reading of white space takes in (fixed values): a text that has one is not cut.
ODD_CODES = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
_ODD = re.compile(f"[{''.join(map(chr, ODD_CODES))}]")
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
#: A line end, a word (of A-Z, a-z, À-Ö, Ø-ö, ø-ɏ in UTF-8) with or without a blank before it, and ASCII signs other than the apostrophe: the
#: splitting pattern sets these apart.
_LETTER = rb"[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4-\xC8][\x80-\xBF]|\xC9[\x80-\x8F]"
_PLAIN = re.compile(rb"(\n?)( ?(?:" + _LETTER + rb")+)([!-&(-/:-@\[-`{-~]*)")
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: By count of bytes, up to 8, the part of a 64-bit word that holds them.
_PART = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Places of the table, pieces in it before it starts anew, bytes of a piece that may enter it.
SLOTS, KEEP, LONGEST = 1 << 21, 1_500_000, 64
#: Characters that are cut together, at least.
CHUNK = 2_000_000
#: Signs after words that are remembered.
KEEP_SIGNS = 20_000


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX1
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


@dataclass
class Pieces:
    """Pieces of bytes that lie in one buffer: the hash, the first 8 bytes, the size and the place of each, and the 8 bytes from each place on."""

    hashes: np.ndarray
    heads: np.ndarray
    size: np.ndarray
    first: np.ndarray
    words: np.ndarray

    def of(self, which: np.ndarray) -> Pieces:
        return Pieces(self.hashes[which], self.heads[which], self.size[which], self.first[which], self.words)

    def rest(self, which: np.ndarray, k: int) -> np.ndarray:
        """Of the pieces at `which`, all longer than k bytes, up to 8 bytes from their k-th on."""
        return self.words[self.first[which] + k] & _PART[np.minimum(self.size[which] - k, 8)]


class Table:
    """Ids of pieces, found by hash; a place also has the piece's bytes, all of which must agree."""

    def __init__(self):
        self.hash, self.head, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint8)
        self.at, self.n, self.more = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.ids, self.used, self.count = np.zeros(1 << 20, np.uint16), 0, 0
        self.bytes, self.filled = np.zeros(1 << 18, np.uint64), 0  # what follows the first 8 bytes, in words of 8

    def _same(self, slot: np.ndarray, pieces: Pieces, which: np.ndarray) -> np.ndarray:
        """Whether the bytes at the slots, whose sizes agree, are those of the pieces at `which` beyond the first 8."""
        same = np.ones(len(which), bool)
        left, k = np.flatnonzero(pieces.size[which] > 8), 8
        while len(left):
            same[left] &= self.bytes[self.more[slot[left]] + k // 8 - 1] == pieces.rest(which[left], k)
            k += 8
            left = left[pieces.size[which[left]] > k]
        return same

    def find(self, pieces: Pieces) -> np.ndarray:
        """The place of each piece, or -1."""
        out, todo = np.full(len(pieces.hashes), -1, np.int64), np.arange(len(pieces.hashes))
        slot = (pieces.hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(todo):
            there = self.hash[slot]
            hit = np.flatnonzero((there == pieces.hashes[todo]) & (self.head[slot] == pieces.heads[todo]) & (self.size[slot] == pieces.size[todo]))
            hit = hit[self._same(slot[hit], pieces, todo[hit])]
            out[todo[hit]] = slot[hit]
            on = there != 0
            on[hit] = False
            todo, slot = todo[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def add(self, pieces: Pieces, ids: list[list[int]]) -> None:
        """Takes in pieces of LONGEST bytes at most that it does not have, each once."""
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint16, int(count.sum()))
        at = self.used + np.cumsum(count) - count
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint16)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used, self.count = self.used + len(flat), self.count + len(ids)
        words = (pieces.size + 7) // 8 - 1
        more = self.filled + np.cumsum(words) - words
        if self.filled + int(words.sum()) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(max(len(self.bytes), int(words.sum())), np.uint64)])
        self.filled += int(words.sum())
        left, k = np.flatnonzero(words > 0), 8
        while len(left):
            self.bytes[more[left] + k // 8 - 1] = pieces.rest(left, k)
            k += 8
            left = left[pieces.size[left] > k]
        todo, slot = np.arange(len(ids)), (pieces.hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(todo):  # of those that meet at a free place, one takes it; the others go on
            one = np.zeros(len(todo), bool)
            one[np.unique(slot, return_index=True)[1]] = True
            one &= self.hash[slot] == 0
            to, own = slot[one], todo[one]
            self.hash[to], self.head[to], self.size[to] = pieces.hashes[own], pieces.heads[own], pieces.size[own]
            self.at[to], self.n[to], self.more[to] = at[own], count[own], more[own]
            todo, slot = todo[~one], (slot[~one] + 1) & (SLOTS - 1)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.chars = self.library.model, np.array([ord(c) for _, c in sorted(byte_chars().items())], "<u4")
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        if self.library.encode("a b\nÉ.", add_special_tokens=False).tokens != ["a", "Ġb", "Ċ", "Ãī", "."]:
            raise ValueError("not a byte-level vocabulary that leaves texts as they are")
        self.table, self.signs = Table(), {}

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _sign(self, text: bytes) -> list[int]:
        if (ids := self.signs.get(text)) is None:
            if len(self.signs) > KEEP_SIGNS:
                self.signs.clear()
            ids = self.signs[text] = self._whole(text.decode())
        return ids

    def _learn(self, pieces: list[bytes]) -> list[list[int]]:
        chars = self.chars[np.frombuffer(b"".join(pieces), np.uint8)].tobytes().decode("utf-32-le")  # one for each byte
        out, at, tokens = [], 0, self.model.tokenize
        for piece in pieces:
            if plain := _PLAIN.fullmatch(piece):
                a, b = plain.span(2)
                ids = [t.id for t in tokens(chars[at + a : at + b])]
                if a:
                    ids = self._sign(piece[:a]) + ids
                if b < len(piece):
                    ids = ids + self._sign(piece[b:])
            else:
                ids = self._whole(piece.decode())
            out.append(ids)
            at += len(piece)
        return out

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts that are safe to cut; none is empty."""
        data = b"".join(texts)
        n, ends = len(data), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        blank = _BLANK[np.frombuffer(data, np.uint8)]
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[0] = True
        begins[ends[:-1]] = True
        first = np.flatnonzero(begins)
        size = np.diff(first, append=n)
        words = np.ndarray((n,), "<u8", data + bytes(8), 0, (1,))  # the 8 bytes from each place on
        heads = words[first] & _PART[np.minimum(size, 8)]
        hashes = _mix(heads + size.astype(np.uint64) * _MIX2)
        more, k = np.flatnonzero(size > 8), 8
        while len(more) and k < LONGEST:
            hashes[more] = _mix((hashes[more] << np.uint64(1)) + (words[first[more] + k] & _PART[np.minimum(size[more] - k, 8)]) * _MIX1)
            k += 8
            more = more[size[more] > k]
        hashes[hashes == 0] = 1
        if self.table.count > KEEP:
            self.table = Table()
        table, short = self.table, np.flatnonzero(size <= LONGEST)
        every, place = Pieces(hashes, heads, size, first, words), np.full(len(first), -1, np.int64)
        place[short] = table.find(every.of(short))
        new = short[place[short] < 0]
        if len(new):
            once = new[np.unique(hashes[new], return_index=True)[1]][: SLOTS // 16 * 15 - table.count]  # what the table has no room for is encoded alone
            pieces = [data[a:b] for a, b in zip(first[once].tolist(), (first[once] + size[once]).tolist(), strict=True)]
            table.add(every.of(once), self._learn(pieces))
            place[new] = table.find(every.of(new))
        lone = np.flatnonzero(place < 0)  # long pieces, and those with the hash of another new one
        extra = [self._whole(data[first[i] : first[i] + size[i]].decode()) for i in lone.tolist()]
        at, count = table.at[place].astype(np.int64), table.n[place].astype(np.int64)
        count[lone] = list(map(len, extra))
        at[lone] = table.used + np.cumsum(count[lone]) - count[lone]
        pool = np.concatenate([table.ids[: table.used], np.array([x for own in extra for x in own], np.uint16)]) if extra else table.ids
        till = np.cumsum(count)
        ids = pool[np.repeat(at - till + count, count) + np.arange(int(till[-1]))].astype("<u2").tobytes()
        last = 2 * till[np.searchsorted(first, ends) - 1]
        return [ids[a:b] for a, b in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]

    def ids(self, texts) -> list[bytes]:
        """For each text (None: empty) its ids as little-endian 16-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, where, size = [], [], 0

        def flush() -> None:
            nonlocal held, where, size
            for k, own in zip(where, self._together(held) if held else [], strict=True):
                out[k].append(own)
            held, where, size = [], [], 0

        for k, t in enumerate(texts):
            if not t:
                continue
            if _ODD.search(t):
                out[k].append(np.array(self._whole(t), "<u2").tobytes())
                continue
            begin = 0
            while begin < len(t):  # a very long text in parts, from one safe cut to the next
                cut = _CUT.search(t, begin + CHUNK) if len(t) - begin > CHUNK else None
                end = cut.start() if cut else len(t)
                part = t[begin:end].encode()
                held.append(part)
                where.append(k)
                size, begin = size + len(part), end
                if size >= CHUNK:
                    flush()
        flush()
        return [b"".join(own) for own in out]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)

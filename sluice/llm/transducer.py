"""Token counts by a finite-state tokenizer: deterministic transducers whose transitions carry emitted-token counts.

Two machines, both built from the vocabulary file of a byte-level BPE tokenizer:

- Words. The merges of BPE are compiled to a deterministic transducer over bytes. A state stands for all ways in which the bytes
  read so far can still go on: for each place where a token may have begun, the token that ends there and the node of the vocabulary's trie
  that the bytes since then have reached. A prefix has one encoding, and two tokens may follow each other only if the merges,
  run on their bytes, give the two back; so the last token of each prefix is determined, the set of open places is bounded by the longest token, and the
  states are finite. They are determinized as they are met and kept in a bounded table. Each transition carries the change in the count of
  tokens.
- Splitting. Characters fall into a few classes (taken from the library itself, so that both agree on every code point), and a machine over
  classes cuts a text into words, apostrophe endings, numbers, signs and white space as the library does.

State maps. The two machines together are one: its state is the kind of the word that is open, the characters that are read but not yet given to a word
(white space, whose last character may go with what follows, or the beginning of an apostrophe ending), and the open places of the word. A
chunk of a text has a state map: entry state -> (exit state, tokens). Where white space follows something else, every state closes its word, so
all entries leave a chunk with such a place by the same exit.

Chunks: a text is cut into chunks of chunk_chars, each with a map of its own. A chunk's entry is not known by itself, so it is taken from a run over
the characters before the chunk, from the start state: right for certain if white space follows something else in them, and nearly
always else, as the merges soon fall into step. Each exit is then held against the entry of the next chunk, and maps whose entry was not
that are made again from it, until all fit. The maps compose associatively: neighbours by neighbours, FAN at a time, level by level, as
the first half of a parallel prefix scan does (the prefixes in between are not asked for). The chunks of a text of more than long_chars are
rows that Spark spreads over its tasks, so none holds such a text; those of others are composed where they are.

Cases: a null or empty text has no bytes and no tokens; repeated rows are counted each for itself; special tokens inside a
text count as the library has them, one each. All columns stay as they are; the count is a column of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_broadcast, free_name, staged
from ._tokens import ODD_CODES, byte_chars

#: Characters of a chunk, of a text that is cut into chunk rows, and of what a chunk's entry is found from.
CHUNK_CHARS, LONG_CHARS, LEAD_CHARS = 1 << 13, 1 << 15, 1 << 12
#: State maps that are composed together.
FAN = 64
#: What a chunk's place, and one with a state, takes in a broadcast.
KEY_BYTES, STATE_BYTES = 64, 2048
#: States, pieces, characters of all these, and characters of one, that a worker keeps before it starts anew.
KEEP_STATES, KEEP_PIECES, KEEP_CHARS, PIECE_CHARS = 250_000, 500_000, 16_000_000, 64
#: The endings that the splitting pattern sets apart after an apostrophe (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_SPACES = " \t\n\r\f\v"
_BLANKS = frozenset(_SPACES)
_ODD = "".join(map(chr, ODD_CODES))
#: Before ASCII white space that follows what no reading takes for white space.
_CUT = re.compile(f"(?<=[^{_SPACES}{_ODD}])(?=[{_SPACES}])")


class WordTransducer:
    """Counts the tokens of one word (no splitting inside), byte by byte."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        back = {c: b for b, c in byte_chars().items()}
        text = {t: bytes(back[c] for c in t) for t in vocabulary if all(c in back for c in t)}
        self.rank = {(text[a], text[b]): k for k, (a, b) in enumerate(merges)}
        #: The trie: children by byte, and the number of the token that ends at a node (-1: none).
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.tokens = sorted({*(bytes([b]) for b in range(256)), *(a + b for a, b in self.rank)})
        for number, t in enumerate(self.tokens):
            node = 0
            for b in t:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                node = self.trie[node][b]
            self.ends[node] = number
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((-1, 0, 0),)
        self.states: dict[tuple, int] = {start: 0}
        self.open: list[tuple] = [start]
        self.step: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, word: bytes) -> list[bytes]:
        """The merges run on a word: always the one of lowest rank, leftmost first."""
        own = [bytes([b]) for b in word]
        while len(own) > 1:
            best = min((self.rank.get(p, 1 << 30), k) for k, p in enumerate(zip(own, own[1:], strict=False)))
            if best[0] == 1 << 30:
                break
            pair = own[best[1]], own[best[1] + 1]
            out, k = [], 0
            while k < len(own):
                if k + 1 < len(own) and (own[k], own[k + 1]) == pair:
                    out.append(own[k] + own[k + 1])
                    k += 2
                else:
                    out.append(own[k])
                    k += 1
            own = out
        return own

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b as they are when they stand together."""
        if (known := self.fits.get((a, b))) is None:
            x, y = self.tokens[a], self.tokens[b]
            known = self.fits[a, b] = self.merged(x + y) == [x, y]
        return known

    def _build(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from a state by a byte: the next state, and by how much the count of tokens changes.

        An open place is (token before it or -1, trie node since, tokens before it less those of the whole prefix); places are in the order
        of their beginnings, so equal states are equal tuples.
        """
        trie, ends = self.trie, self.ends
        places, count, last = [], None, -1
        for before, node, less in self.open[state]:
            if (to := trie[node].get(byte)) is not None:
                if count is None and (token := ends[to]) >= 0 and (before < 0 or self.follows(before, token)):
                    count, last = less + 1, token
                if trie[to]:
                    places.append((before, to, less))
        if count is None:
            raise RuntimeError("a byte has no token")
        if count:
            places = [(b, n, x - count) for b, n, x in places]
        places.append((last, 0, 0))
        out = self.step[state][byte] = (self.enter(tuple(places)), count)
        return out

    def enter(self, places: tuple) -> int:
        """The state of these open places."""
        if (to := self.states.get(places)) is None:
            to = self.states[places] = len(self.open)
            self.open.append(places)
            self.step.append({})
        return to

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """(state after the bytes, tokens they add)."""
        step, total = self.step, 0
        for b in data:
            state, change = step[state].get(b) or self._build(state, b)
            total += change
        return state, total

    def count(self, word: bytes) -> int:
        return self.run(0, word)[1]

    def trim(self) -> None:
        """Forgets states and pairs once there are too many; they are built again as they are met."""
        if len(self.open) > KEEP_STATES:
            self.reset()
        if len(self.fits) > KEEP_STATES:
            self.fits.clear()


@dataclass(frozen=True)
class State:
    """Where the machine stands: kind of the open word ('' none, L, N, O, S white space, A apostrophe), characters held back, open places of the word."""

    kind: str = ""
    held: str = ""
    places: tuple = ((-1, 0, 0),)

    def key(self) -> str:
        return json.dumps([self.kind, self.held, self.places])

    @staticmethod
    def of(key: str) -> State:
        kind, held, places = json.loads(key)
        return State(kind, held, tuple(map(tuple, places)))


START = State()
#: A state map: entry -> (exit, tokens), for the entries it is known for.
StateMap = dict[State, tuple[State, int]]


def compose(maps: list[StateMap]) -> StateMap:
    """The maps one after another; associative. Entries whose way leaves what the maps are known for are left out."""
    out = {}
    for entry in maps[0]:
        at, total = entry, 0
        for m in maps:
            if at not in m:
                break
            at, n = m[at]
            total += n
        else:
            out[entry] = (at, total)
    return out


def composed(maps: list[StateMap]) -> StateMap:
    """All maps as one, FAN neighbours at a time, level by level."""
    while len(maps) > 1:
        maps = [compose(maps[k : k + FAN]) for k in range(0, len(maps), FAN)]
    return maps[0]


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.words = WordTransducer(spec["model"]["vocab"], merges)
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.classes: dict[str, str] = {}
        self.path = path
        self._library = None
        self.known: dict[str, int] = {}
        self.kept = 0

    def kind(self, c: str) -> str:
        """L letter, N number, S white space, O other, by what the library joins the character to."""
        if (k := self.classes.get(c)) is None:
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path).pre_tokenizer
            alone = lambda x: len(self._library.pre_tokenize_str(x)) == 1
            k = self.classes[c] = "L" if alone("a" + c) else "N" if alone("1" + c) else "O" if alone("!" + c) else "S"
        return k

    def split(self, text: str) -> list[str]:
        """The words of a text by the machine over classes: one pass, a character of look-ahead."""
        kinds = [self.classes.get(c) or self.kind(c) for c in text]
        out, k, n = [], 0, len(text)
        while k < n:
            start = k
            if text[k] == "'":
                end = next((e for e in ENDINGS if text.startswith(e, k + 1)), None)
                if end:
                    out.append(text[k : (k := k + 1 + len(end))])
                    continue
            if kinds[k] == "S":
                j = k
                while j < n and kinds[j] == "S":
                    j += 1
                if j < n:  # the last white space before something else is left to it if it is a blank, or is a word of its own
                    if j - k > 1:
                        out.append(text[k : j - 1])
                        k = j - 1
                        continue
                    if text[k] != " ":
                        out.append(text[k])
                        k = j
                        continue
                    k = j
                else:
                    out.append(text[k:j])
                    k = j
                    continue
            own = kinds[k]
            while k < n and kinds[k] == own:
                k += 1
            out.append(text[start:k])
        return out

    def count_piece(self, piece: str) -> int:
        """Tokens of a piece that begins and ends at safe cuts."""
        if (n := self.known.get(piece)) is None:
            n = sum(self.words.count(w.encode("utf-8", "replace")) for w in self.split(piece))
            if len(piece) <= PIECE_CHARS:
                self.known[piece] = n
                self.kept += len(piece)
        return n

    def trim(self) -> None:
        if len(self.known) > KEEP_PIECES or self.kept > KEEP_CHARS:
            self.known.clear()
            self.kept = 0
        self.words.trim()

    # --- states -------------------------------------------------------------------------------------------------
    def step(self, state: State, text: str) -> tuple[State, int]:
        """(state after the characters, tokens they add), one by one."""
        words, total = self.words, 0
        kind, held, word = state.kind, state.held, words.enter(state.places)

        def give(chars: str) -> None:
            nonlocal word, total
            word, n = words.run(word, chars.encode("utf-8", "replace"))
            total += n

        for c in text:
            k = self.classes.get(c) or self.kind(c)
            if kind == "A":
                if held[1:] + c in ENDINGS:
                    give(held + c)
                    kind, held, word = "", "", 0
                    continue
                if any(e.startswith(held[1:] + c) for e in ENDINGS):
                    held += c
                    continue
                give("'")
                kind = "O"
                if len(held) > 1:  # the letter after the apostrophe begins a word
                    word = 0
                    give(held[1:])
                    kind = "L"
                held = ""
            elif kind == "S":
                if k == "S":
                    give(held)
                    held = c
                    continue
                word = 0
                give(held)
                if held == " ":  # goes with what follows
                    give(c)
                    kind, held = k, ""
                    continue
                kind, held, word = "", "", 0
            if kind and k != kind:
                kind, word = "", 0
            if kind:
                give(c)
            elif k == "S":
                kind, held = "S", c
            elif c == "'":
                kind, held = "A", c
            else:
                kind = k
                give(c)
        return State(kind, held, words.open[word]), total

    def close(self, state: State) -> int:
        """Tokens that the end of the text, or white space after something else, adds."""
        if state.kind == "S":
            return self.words.run(self.words.enter(state.places), state.held.encode("utf-8", "replace"))[1]
        if state.kind == "A":
            return self.words.count(b"'") + (self.words.count(state.held[1:].encode()) if len(state.held) > 1 else 0)
        return 0

    def through(self, state: State, chunk: str) -> tuple[State, int]:
        """(exit, tokens) of a chunk entered in a state: the characters up to the first safe cut and after the last go one by one, pieces between are known."""
        pieces, total = _CUT.split(chunk), 0
        if chunk[:1] in _BLANKS and state.kind in ("L", "N", "O"):
            state = START  # the border closes the word
        if len(pieces) == 1:
            state, n = self.step(state, chunk)
            return state, total + n
        if state == START:
            total += self.count_piece(pieces[0])
        else:
            state, n = self.step(state, pieces[0])
            total += n + self.close(state)
        known = self.known
        for p in pieces[1:-1]:
            n = known.get(p)
            total += self.count_piece(p) if n is None else n
        state, n = self.step(START, pieces[-1])
        return state, total + n

    def lead(self, run: str, at: int) -> str:
        """The characters before a chunk that its entry is found from: those since the last safe cut, LEAD_CHARS at most."""
        return _CUT.split(run[max(0, at - LEAD_CHARS) : at])[-1]

    def map_of(self, lead: str, chunk: str, entry: State | None = None) -> StateMap:
        """The map of a chunk for one entry: the one given, else what its lead leads to from the start."""
        entry = self.step(START, lead)[0] if entry is None else entry
        self.trim()
        out = {entry: self.through(entry, chunk)}
        self.trim()
        return out

    def maps(self, run: str, chunk_chars: int) -> list[StateMap]:
        """The map of each chunk of a text without special tokens, by itself; then, where an entry was not the exit before it, for that exit too."""
        starts = range(0, len(run), chunk_chars)
        out, at = [self.map_of(self.lead(run, k), run[k : k + chunk_chars]) for k in starts], START
        for k, own in zip(starts, out, strict=True):
            if at not in own:
                own |= self.map_of("", run[k : k + chunk_chars], at)
            at = own[at][0]
        return out

    def runs(self, text: str) -> list[str]:
        """The text between special tokens."""
        return self._special.split(text) if self._special is not None and any(s in text for s in self.specials) else [text]

    def count(self, text: str | None, chunk_chars: int = CHUNK_CHARS) -> int:
        """Tokens of a whole text, by the maps of its chunks."""
        if not text:
            return 0
        runs = self.runs(text)
        total = len(runs) - 1
        for run in runs:
            if len(run) <= chunk_chars:  # one chunk, whose last piece is closed at once
                known = self.known
                for p in _CUT.split(run):
                    n = known.get(p)
                    total += self.count_piece(p) if n is None else n
                continue
            exit, n = composed(self.maps(run, chunk_chars))[START]
            total += n + self.close(exit)
        return total


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One transducer for each worker process and vocabulary."""
    return Transducer(path)


def _short(text: Column, path: str, chunk_chars: int) -> Column:
    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(path)
        for texts in batches:
            counts = []
            for t in texts:
                counts.append(machine.count(t, chunk_chars))
                machine.trim()
            yield pd.Series(counts, dtype="int64")

    return tokens(text)


_CHUNK = "row long, run int, chunk int, lead string, text string"
_MAP = "row long, run int, chunk int, entry string, exit string, n long"


def _chunk_rows(long: DataFrame, path: str, chunk_chars: int) -> DataFrame:
    """(row, run, chunk, lead, text): the chunks of long texts (row, text) between special tokens, and the characters before each."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"], strict=True):
                for k, run in enumerate(machine.runs(text)):
                    for c, at in enumerate(range(0, max(1, len(run)), chunk_chars)):
                        yield pd.DataFrame([(row, k, c, machine.lead(run, at), run[at : at + chunk_chars])], columns=["row", "run", "chunk", "lead", "text"])

    return long.mapInPandas(cut, _CHUNK)


def _maps(chunks: DataFrame, path: str) -> DataFrame:
    """The state map of each chunk for one entry: `entry` if there is one, else what its lead gives."""
    names = [f.split()[0] for f in _MAP.split(", ")]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                for entry, (exit, n) in machine.map_of(r.lead, r.text, State.of(r.entry) if r.entry else None).items():
                    out.append((r.row, r.run, r.chunk, entry.key(), exit.key(), n))
            yield pd.DataFrame(out, columns=names)

    return chunks.mapInPandas(make, _MAP)


def _long(long: DataFrame, path: str, chunk_chars: int) -> DataFrame:
    """(row, n): tokens of the long texts (row, text), by the state maps of their chunks."""
    place = ["row", "run", "chunk"]
    chunks = staged(_chunk_rows(long, path, chunk_chars).withColumn("entry", F.lit(None).cast("string")), "chunks")
    spread = lambda rows: rows.repartition(F.xxhash64(*place))  # noqa: E731  a text's chunks go to many tasks
    maps = staged(_maps(spread(chunks), path), "maps")
    while True:  # each round settles at least the first chunk of a text whose entry was not the exit before it
        before = F.coalesce(F.lag("exit").over(Window.partitionBy("row", "run").orderBy("chunk")), F.lit(START.key()))
        held = maps.withColumn("before", before)
        wrong = staged(held.where("entry != before").select(*place, F.col("before").alias("entry")), "wrong")
        n = wrong.count()
        if not n:
            break
        again = staged(_maps(spread(chunks.drop("entry").join(bounded_broadcast(wrong, n, STATE_BYTES), place)), path), "corrections")
        maps = maps.join(bounded_broadcast(wrong.select(*place), n, KEY_BYTES), place, "left_anti").select(*maps.columns).unionByName(again)
    levels = maps.agg(F.max("chunk")).first()[0]

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        whole = compose([{State.of(a): (State.of(b), int(n))} for a, b, n in zip(rows["entry"], rows["exit"], rows["n"], strict=True)])
        return pd.DataFrame([(rows["row"].iloc[0], rows["run"].iloc[0], rows["chunk"].iloc[0] // FAN, a.key(), b.key(), n) for a, (b, n) in whole.items()], columns=[f.split()[0] for f in _MAP.split(", ")])

    while levels:
        maps = maps.groupBy("row", "run", F.floor(F.col("chunk") / FAN).alias("g")).applyInPandas(join, _MAP)
        levels //= FAN
    maps = staged(maps, "composed")

    @F.pandas_udf("long")
    def closing(exits: pd.Series) -> pd.Series:
        machine = transducer(path)
        return pd.Series([machine.close(State.of(x)) for x in exits], dtype="int64")

    per = maps.withColumn("n", F.col("n") + closing("exit")).groupBy("row").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("runs"))
    return per.select("row", (F.col("n") + F.col("runs") - 1).alias("n"))


def count_tokens(documents: DataFrame, path: str, text_col: str = "text", count_col: str = "n_tokens", chunk_chars: int = CHUNK_CHARS, long_chars: int = LONG_CHARS) -> DataFrame:
    """documents with the token count of each whole text in count_col; the library's count without added special tokens."""
    if count_col in documents.columns:
        raise ValueError(f"documents have a column {count_col!r}")
    text, row = F.col(text_col), free_name(documents, "row")
    is_long = F.coalesce(F.length(text) > long_chars, F.lit(False))
    short = documents.where(~is_long).withColumn(count_col, _short(text, path, chunk_chars))
    long = staged(documents.where(is_long).withColumn(row, F.monotonically_increasing_id()), "long-texts")
    if long.isEmpty():
        return short
    counted = staged(_long(long.select(F.col(row).alias("row"), text.alias("text")), path, chunk_chars), "long-counts")
    named = counted.select(F.col("row").alias(row), F.col("n").alias(count_col))
    whole = long.join(bounded_broadcast(named, named.count(), KEY_BYTES), row).drop(row)
    return short.unionByName(whole.select(*short.columns))

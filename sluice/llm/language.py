"""Language identification: scripts narrow the candidates, per-word scores and a Viterbi path label the spans of a text.

Training: character trigrams of the words of a bounded sample of labelled texts (about sample_docs whole texts a language, chosen by a hash of
their id) are counted per language in Spark, into BUCKETS hashed buckets, with the letters of each script. A language is a candidate for a script if
at least MIN_SCRIPT of its letters are of it.

Prediction: each word has a log score for each language, 0 for the best and FLOOR at least, or FLOOR for every WORD_LETTERS letters of a longer
word, so that a clause of a script without blanks counts as the words it holds. Where a word's script has candidates, other languages are
ruled out: they score less than two changes of language cost, so that the path leaves them for a single word. The path through a text's words that maximizes the sum of scores, less switch_cost for every change of language, labels each word; runs of
one label are the spans. A text's language is the one with most letters, and its score that language's share of them.
Where
the best single language of a text is ahead of the others by every path, its words have that label at once; the path is computed for the
other stretches only. This is exact.

Cases: a null text, or one without letters, is `und` with score 0 and no spans; ties go to the language first in order; rows are
predicted one by one, so repeated rows agree; without training rows every text is `und`; a column of more than most_languages languages is an error, as
the model has a table for each. A text of over STEP_CHARS characters is gone through in blocks of words, with the same result. Extra columns stay untouched.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import steps

SAMPLE_DOCS = 1500
BUCKETS = 1 << 16
MIN_SCRIPT = 0.002
FLOOR = -6.0
#: Letters of a word that FLOOR is for; longer words have a floor in proportion.
WORD_LETTERS = 6
SWITCH_COST = 12.0
KEEP_WORDS = 250_000
#: Characters of texts that are labelled together; of a longer text, its words are looked up in blocks of STEP_WORDS.
STEP_CHARS, STEP_WORDS = 1 << 20, 1 << 16
#: Languages that a model may have: it keeps a table of BUCKETS numbers for each.
MOST_LANGUAGES = 200
UNKNOWN = "und"
#: First code points of script ranges (fixed values of the Unicode block charts); a range ends where the next begins.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, "Other"), (0x20000, "Han"),
]
_STARTS = [s for s, _ in SCRIPTS]
_WORD = re.compile(r"[^\W\d_]+")


def script_of(c: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(c)) - 1][1]


def _word_blocks(text: str) -> Iterator[list[str]]:
    """The words of a text, STEP_WORDS at a time."""
    found = _WORD.finditer(text)
    while some := [m.group() for m in islice(found, STEP_WORDS)]:
        yield some


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of each word in lower case between edges, and where each word's begin."""
    text = "".join(f"\x02{w.lower()}\x03" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    h = (h ^ (h >> np.uint64(15))) % np.uint64(BUCKETS)
    inside = c[1:-1] != 3  # a trigram that reaches over a word's end begins at its last letter
    inside &= c[:-2] != 3
    starts = np.flatnonzero(c == 2)
    before = np.concatenate([[0], np.cumsum(inside)])
    return h[inside].astype(np.int64), before[starts]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_p: np.ndarray  # languages x BUCKETS
    candidates: dict[str, np.ndarray]  # script: which languages use it

    def ruled_out(self, words: list[str]) -> np.ndarray:
        """words x languages: whether a word's script has candidates and the language is none of them."""
        scripts = np.array([script_of(w[0]) for w in words])
        out = np.zeros((len(words), len(self.languages)), bool)
        for script in np.unique(scripts):
            allowed = self.candidates.get(script)
            if allowed is not None and allowed.any() and not allowed.all():
                out[np.ix_(scripts == script, ~allowed)] = True
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """words x languages: log scores, 0 for the best language of a word, its floor at least."""
        h, starts = _trigrams(words)
        raw = np.add.reduceat(self.log_p[:, h], starts, axis=1).T
        raw[self.ruled_out(words)] = -np.inf
        floor = FLOOR * np.maximum(1, np.fromiter(map(len, words), np.float64, len(words)) / WORD_LETTERS)
        return np.maximum(raw - raw.max(axis=1, keepdims=True), floor[:, None]).astype(np.float32)


class Tagger:
    """Labels texts; keeps the scores of the words it has met."""

    def __init__(self, model: Model, switch_cost: float):
        self.model, self.cost = model, switch_cost
        self.number: dict[str, int] = {}
        self.rows = np.empty((0, len(model.languages)), np.float32)
        self.sizes = np.empty(0, np.int64)

    def _learn(self, words: set[str]) -> None:
        if len(self.number) > KEEP_WORDS:
            self.number.clear()
            self.rows, self.sizes = self.rows[:0], self.sizes[:0]
        new = [w for w in words if w not in self.number]
        letters = [w for w in new if any(c.isalpha() for c in w)]
        self.number.update((w, -1) for w in set(new).difference(letters))
        if letters:
            first = len(self.rows)
            scores, out = self.model.scores(letters), self.model.ruled_out(letters)
            scores[out] = np.minimum(scores[out], -2 * self.cost - 1)
            self.rows = np.concatenate([self.rows, scores])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, letters), np.int64, len(letters))])
            self.number.update((w, first + k) for k, w in enumerate(letters))

    def words(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of each text the numbers of its words."""
        cut = [_WORD.findall(t) if t else [] for t in texts]
        self._learn({w for ws in cut for w in ws})
        out = [np.fromiter(map(self.number.__getitem__, ws), np.int64, len(ws)) for ws in cut]
        return [n[n >= 0] for n in out]

    def _blocks(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(scores, letters) of a text's words, a block at a time."""
        for some in _word_blocks(text):
            self._learn(set(some))
            numbers = np.fromiter(map(self.number.__getitem__, some), np.int64, len(some))
            numbers = numbers[numbers >= 0]
            if len(numbers):
                yield self.rows[numbers].astype(np.float64), self.sizes[numbers]

    def labels(self, numbers: np.ndarray) -> np.ndarray:
        """The languages of a text's words by the best path; the text is not empty."""
        s = self.rows[numbers].astype(np.float64)
        best, c, n = int(s.sum(axis=0).argmax()), self.cost, len(s)
        out = np.full(n, best)
        # How much more than -c every language can be ahead of the best one by a word, while the best one is never behind any: a walk held at 0 from
        # below that starts at c. At most 0: a best path has the best language here, whatever follows. At most c: the best language is ahead.
        gain = np.cumsum(s - s[:, [best]], axis=0)
        low = np.full_like(gain, -c)
        np.minimum(np.minimum.accumulate(gain[:-1], axis=0), -c, out=low[1:])
        ahead = np.delete(gain - low, best, axis=1).max(axis=1, initial=-np.inf)
        self._stretches(ahead > c, ahead <= 0, s.__getitem__, best, s.shape[1], out)
        return out

    def long_labels(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(labels, letters) of the words of a text that is gone through block by block, once for each step of labels(); what is kept of a word is a few bytes."""
        total, sizes, c = 0.0, [], self.cost
        for s, letters in self._blocks(text):
            total = total + s.sum(axis=0)
            sizes.append(letters.astype(np.int32))
        if not sizes:
            return np.empty(0, np.int16), np.empty(0, np.int32)
        best, width = int(total.argmax()), len(total)
        gain, low, over, sure = np.zeros(width), np.full(width, -c), [], []
        for s, _ in self._blocks(text):
            gains = gain + np.cumsum(s - s[:, [best]], axis=0)
            lows = np.minimum(np.vstack([low, np.minimum.accumulate(gains[:-1], axis=0)]), low)
            ahead = np.delete(gains - lows, best, axis=1).max(axis=1, initial=-np.inf)
            over.append(ahead > c)
            sure.append(ahead <= 0)
            gain, low = gains[-1], np.minimum(low, gains.min(axis=0))
        blocks, block, base = self._blocks(text), np.empty((0, width)), 0

        def at(t: int) -> np.ndarray:  # words are asked for in order
            nonlocal block, base
            while t >= base + len(block):
                base, block = base + len(block), next(blocks)[0]
            return block[t - base]

        out = np.full(sum(map(len, sizes)), best, np.int16)
        self._stretches(np.concatenate(over), np.concatenate(sure), at, best, width, out)
        return out, np.concatenate(sizes)

    def _stretches(self, over: np.ndarray, sure: np.ndarray, at: Callable[[int], np.ndarray], best: int, width: int, out: np.ndarray) -> None:
        """Labels the stretches in which another language gets ahead of the best one."""
        over, done = np.flatnonzero(over), 0  # words before done have their labels
        while (k := np.searchsorted(over, done)) < len(over):
            first = over[k]
            back = np.flatnonzero(sure[done:first])
            begin = done + int(back[-1]) + 1 if len(back) else done
            done = begin + self._path(at, len(out), width, best, begin, first, out)

    def _path(self, at: Callable[[int], np.ndarray], n: int, width: int, best: int, begin: int, past: int, out: np.ndarray) -> int:
        """Viterbi from begin on, until after past it is sure that the path is back at the best language; how many words it labelled."""
        c = self.cost
        value = np.where(np.arange(width) == best, 0.0, -c) if begin else np.zeros(width)
        value, ways = value + at(begin), []
        t = begin
        while t + 1 < n and not (t >= past and np.delete(value, best).max(initial=-np.inf) + c <= value[best]):
            t += 1
            top = int(value.argmax())
            stay = value >= value[top] - c
            ways.append((stay, top))
            value = np.maximum(value, value[top] - c) + at(t)
        own = int(value.argmax()) if t + 1 == n else best
        for k in range(t, begin - 1, -1):
            out[k] = own
            if k > begin and not ways[k - begin - 1][0][own]:
                own = ways[k - begin - 1][1]
        return t + 1 - begin


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, most_languages: int = MOST_LANGUAGES) -> Model:
    """A model from about sample_docs whole texts of each language; rows without text or language teach nothing. More than most_languages are an error."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"column {lang_col!r} has more than {most_languages} values; clean it or raise the bound")
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((0, BUCKETS), np.float32), {})
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample_docs / sizes[lang])))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1_000_000)) / 1e6
    sample = rows.where(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        scripts: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for some in _word_blocks(text):
                    words = [w for w in some if any(c.isalpha() for c in w)]
                    if words:
                        np.add.at(own, _trigrams(words)[0], 1)
                        for w in words:
                            key = lang, script_of(w[0])
                            scripts[key] = scripts.get(key, 0) + len(w)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "script": "", "bucket": at, "n": own[at]})
        for (lang, script), n in scripts.items():
            yield pd.DataFrame({"lang": [lang], "script": [script], "bucket": [-1], "n": [n]})

    counted = sample.mapInPandas(count, "lang string, script string, bucket long, n long").groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    tables = np.full((len(languages), BUCKETS), 0.5)
    letters: dict[str, np.ndarray] = {}
    place = {lang: k for k, lang in enumerate(languages)}
    at = counted["lang"].map(place).to_numpy(np.int64) if len(counted) else np.empty(0, np.int64)
    grams = counted["bucket"].to_numpy(np.int64) >= 0 if len(counted) else np.empty(0, bool)
    tables[at[grams], counted["bucket"].to_numpy(np.int64)[grams]] += counted["n"].to_numpy(np.float64)[grams]
    for k, script, n in zip(at[~grams], counted["script"][~grams], counted["n"][~grams], strict=True):
        letters.setdefault(script, np.zeros(len(languages)))[k] = n
    total = np.maximum(sum(letters.values()), 1) if letters else 1
    log_p = np.log(tables / tables.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(languages, log_p, {s: n / total >= MIN_SCRIPT for s, n in letters.items()})


def identify(text: Column, model: Model, switch_cost: float = SWITCH_COST) -> Column:
    """Column of struct(lang string, score double, spans array of (first word, words, lang)) for whole texts."""
    languages, state = model.languages, (model.languages, model.log_p, model.candidates)

    @F.pandas_udf("lang string, score double, spans array<struct<word:long,words:long,lang:string>>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(Model(*state), switch_cost) if languages else None
        for texts in batches:
            out = []
            values = texts.tolist()
            for some in steps(values, STEP_CHARS):
                if tagger is None:
                    labelled = [(np.empty(0, int), np.empty(0, int))] * len(some)
                elif len(some[0] or "") > STEP_CHARS:
                    labelled = [tagger.long_labels(some[0])]
                else:
                    labelled = ((tagger.labels(n) if len(n) else n, tagger.sizes[n]) for n in tagger.words(some))
                for own, sizes in labelled:
                    if not len(own):
                        out.append((UNKNOWN, 0.0, []))
                        continue
                    letters = np.bincount(own, sizes, len(languages))
                    best = int(letters.argmax())
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
                    spans = [{"word": int(a), "words": int(b - a), "lang": languages[own[a]]} for a, b in zip(edges, edges[1:], strict=False)]
                    out.append((languages[best], float(letters[best] / letters.sum()), spans))
            yield pd.DataFrame(out, columns=["lang", "score", "spans"])

    return label(text)


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that the contract lets the model learn from: crc32 of the id as text, modulo 3, is not 1. A null id is not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose remainder is 1; never null: a null id has none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))

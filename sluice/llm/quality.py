"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own measurements (case, symbols, repetition, length, ...) and those of the
lines before and after it; the chain adds a weight for each pair of neighbouring labels. Forward-backward gives each line's
marginal of being good, and the marginals, weighted by the lines' lengths, make the document's quality; a logistic curve fitted on the same training
documents turns that into the score.

Training uses sample_docs whole labelled documents a class (all, if fewer), those whose ids hash lowest, as far as they have at most
sample_lines lines together. Labels belong to documents, so lines get
theirs in two steps: a logistic model takes each line for as good as its document; then the lines of bad documents that it finds
clearly good are called good, and the chain is trained on those labels by gradient ascent.

Work in Spark: features, forward-backward and scores are computed inside tasks, for about STEP_CHARS characters of lines at a time; of a line that is done a
task keeps four numbers. The driver sees the feature rows of the sample only.

Cases: a null text, an empty one, or one of white space alone has no lines and score 0; repeated rows agree; without training rows of both
classes every score is 0.5 (0 without lines). Extra columns stay untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import steps

SAMPLE_DOCS = 1200
#: Documents of more lines (of any kind) are scored like all others, but teach nothing; nor do those after the first SAMPLE_TOTAL lines of a class.
SAMPLE_LINES, SAMPLE_TOTAL = 1000, 100_000
#: Lines of bad documents above this probability of the line model are called good.
CLEARLY_GOOD = 0.8
THRESHOLD = 0.3
#: Characters of lines whose features are computed together, and of a line that are looked at together.
STEP_CHARS, SLICE = 1 << 20, 1 << 18
OWN = ("upper", "letters", "digits", "blanks", "stops", "marks", "symbols", "pipes", "repeats", "distinct", "first_upper", "word_length", "log_words", "ends", "seen")
WIDTH = 3 * len(OWN) + 3
_WORDS = re.compile(r"\S+")
#: A line as str.splitlines() cuts it, if it is not empty (fixed values).
_LINES = re.compile("[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+")
_KINDS = (1, 2, 4, 8, 16, 32, 64, 128)


def _char_table() -> np.ndarray:
    """For code points below 65536 (all above count as the last of them, an other sign) a bit for each kind: 1 upper, 2 letter, 4 digit, 8 blank, 16 stop, 32 quote or bracket, 64 other sign, 128 pipe."""
    out = np.zeros(1 << 16, np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        if c.isalpha():
            out[k] = 2 | c.isupper()
        elif c.isdigit():
            out[k] = 4
        elif c.isspace():
            out[k] = 8
        elif c in ".,;:":
            out[k] = 16
        elif c in "'\"()-?¿¡«»’“”–—":
            out[k] = 32
        elif c == "|":
            out[k] = 128
        else:
            out[k] = 64
    return out


_TABLE: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """The kind of each character."""
    if not _TABLE:
        _TABLE.append(_char_table())
    return _TABLE[0][np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), 0xFFFF)]


def _ends(line: str) -> bool:
    k = len(line)
    while line[k - 1].isspace():
        k -= 1
    return line[k - 1] in ".!?"


def _features(share: list[np.ndarray], same: np.ndarray, distinct: np.ndarray, upper_first: np.ndarray, size: np.ndarray, n: np.ndarray, ends: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Lines x OWN, from the shares of the kinds of characters and counts of words."""
    return np.stack(
        [
            share[0] / np.maximum(share[1], 1e-9), share[1], share[2], share[3], share[4], share[5], share[6] * 4, share[7] * 10,
            same / n, np.minimum(distinct / n, 1), upper_first / n, size / n / 10, np.log1p(n) / 5, ends, seen,
        ],
        axis=1,
    ).astype(np.float64)


def _block(lines: list[str], seen: list[bool]) -> np.ndarray:
    """The features of lines, all at once."""
    size = np.array([len(x) for x in lines], np.int64)
    kind = _codes("".join(lines))
    starts = np.cumsum(size) - size
    share = [np.add.reduceat((kind & bit > 0).astype(np.int32), starts) / size for bit in _KINDS]
    words = [_WORDS.findall(x) for x in lines]
    n = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((hash(w) for ws in words for w in ws), np.int64, int(n.sum()))
    of = np.repeat(np.arange(len(lines)), n)
    first = np.cumsum(n) - n
    same = np.zeros(len(flat), bool)
    same[1:] = (flat[1:] == flat[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((flat, of))
    new = np.ones(len(flat), bool)
    new[1:] = (flat[order][1:] != flat[order][:-1]) | (of[order][1:] != of[order][:-1])
    upper_first = np.fromiter((w[0].isupper() for ws in words for w in ws), bool, len(flat))
    counts = [np.add.reduceat(x.astype(np.int64), first) for x in (same, new, upper_first)]
    return _features(share, *counts, size, n, np.array([_ends(x) for x in lines]), np.array(seen))


def _long_line(line: str, seen: bool) -> np.ndarray:
    """The features of one line, a slice of its characters and some of its words at a time."""
    share = np.zeros(8)
    for k in range(0, len(line), SLICE):
        kind = _codes(line[k : k + SLICE])
        share += [np.count_nonzero(kind & bit) for bit in _KINDS]
    words, last, same, upper = _WORDS.finditer(line), None, 0, 0
    met = np.empty(0, np.int64)
    n = 0
    while some := [m.group() for m in islice(words, SLICE // 8)]:
        flat = np.fromiter(map(hash, some), np.int64, len(some))
        same += int((flat[1:] == flat[:-1]).sum()) + (flat[0] == last)
        upper += sum(w[0].isupper() for w in some)
        met, last, n = np.union1d(met, flat), flat[-1], n + len(some)
    one = lambda x: np.array([x])
    return _features([one(x / len(line)) for x in share], one(same), one(len(met)), one(upper), one(len(line)), one(n), one(_ends(line)), one(seen))


def line_blocks(texts: list[str | None], counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, lengths) of all lines that are not blank, in order, some at a time; adds the lines of each text to counts."""
    lines, seen, chars = [], [], 0
    for k, t in enumerate(texts):
        met: set[int] = set()
        for m in _LINES.finditer(t or ""):
            line = m.group()
            if line.isspace():
                continue
            mark = hash(line)
            counts[k] += 1
            if len(line) > STEP_CHARS:
                if lines:
                    yield _block(lines, seen), np.array([len(x) for x in lines], np.float64)
                    lines, seen, chars = [], [], 0
                yield _long_line(line, mark in met), np.array([len(line)], np.float64)
            else:
                lines.append(line)
                seen.append(mark in met)
                chars += len(line)
                if chars > STEP_CHARS or len(lines) > STEP_CHARS // 32:
                    yield _block(lines, seen), np.array([len(x) for x in lines], np.float64)
                    lines, seen, chars = [], [], 0
            met.add(mark)
    if lines:
        yield _block(lines, seen), np.array([len(x) for x in lines], np.float64)


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines that are not blank, their lengths, lines of each text)."""
    counts = np.zeros(len(texts), np.int64)
    blocks = list(line_blocks(texts, counts))
    if not blocks:
        return np.zeros((0, len(OWN))), np.zeros(0), counts
    return np.concatenate([b for b, _ in blocks]), np.concatenate([s for _, s in blocks]), counts


def chain_features(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (0 at the ends of a text), whether there are such lines, and 1."""
    n = len(own)
    ends = np.cumsum(counts)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    full = counts > 0
    first[(ends - counts)[full]] = True
    last[(ends - 1)[full]] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.column_stack([own, before, after, first, last, np.ones(n)])


def _ways(unary: np.ndarray, pair: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score of bad and good, log sums of all ways up to each line, and after it, log partition of each text that has lines)."""
    order = np.argsort(-counts, kind="stable")
    ends = np.cumsum(counts)
    start, size = (ends - counts)[order], counts[order]
    longest = int(size[0]) if len(size) else 0
    score = np.zeros((len(unary), 2))
    score[:, 1] = unary
    ahead, behind = np.empty_like(score), np.zeros_like(score)
    less = -size
    active = lambda t: int(np.searchsorted(less, -t, "left"))  # noqa: E731  texts of more than t lines
    for t in range(longest):
        at = start[: active(t)] + t
        if t == 0:
            ahead[at] = score[at]
        else:
            x = ahead[at - 1][:, :, None] + pair
            ahead[at] = np.logaddexp(x[:, 0], x[:, 1]) + score[at]
    for t in range(longest - 2, -1, -1):
        at = start[: active(t + 1)] + t
        x = (behind[at + 1] + score[at + 1])[:, None, :] + pair
        behind[at] = np.logaddexp(x[:, :, 0], x[:, :, 1])
    return score, ahead, behind, np.logaddexp(*ahead[(ends - 1)[counts > 0]].T)


def good_lines(unary: np.ndarray, pair: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The probability that each line is good, by forward-backward."""
    _, ahead, behind, z = _ways(unary, pair, counts)
    return np.exp(np.minimum(ahead[:, 1] + behind[:, 1] - np.repeat(z, counts[counts > 0]), 0))


def marginals(unary: np.ndarray, pair: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability that each line is good, expected neighbour counts 2 x 2, log partition) by forward-backward.

    unary: score of good against bad for each line; pair[a, b]: score of label a before label b. All texts go side by side, a step for
    each line of the longest.
    """
    score, ahead, behind, z = _ways(unary, pair, counts)
    of = np.repeat(z, counts[counts > 0])
    good = np.exp(np.minimum(ahead[:, 1] + behind[:, 1] - of, 0))
    linked = np.ones(len(unary), bool)
    linked[(np.cumsum(counts) - counts)[counts > 0]] = False
    at = np.flatnonzero(linked)
    joint = np.exp(ahead[at - 1][:, :, None] + pair + (score[at] + behind[at])[:, None, :] - of[at][:, None, None])
    return good, joint.sum(axis=0), float(z.sum())


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    pair: np.ndarray
    slope: float
    shift: float

    def quality(self, texts: list[str | None]) -> np.ndarray:
        """The length-weighted mean marginal of the lines of each text; nan without lines.

        A line's score is the sum of what its own features, and those of its neighbours, add to it, so these three numbers are all that is kept of it.
        """
        counts, n = np.zeros(len(texts), np.int64), len(OWN)
        by = self.weight / self.spread
        parts = [(own @ by[: 3 * n].reshape(3, n).T, size) for own, size in line_blocks(texts, counts)]
        if not parts:
            return np.full(len(texts), np.nan)
        each, size = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        del parts
        full = counts > 0
        first, last = (np.cumsum(counts) - counts)[full], (np.cumsum(counts) - 1)[full]
        before, after = np.roll(each[:, 1], 1), np.roll(each[:, 2], -1)
        before[first], after[last] = 0, 0
        unary = each[:, 0] + before + after + (by[-1] - self.mean @ by)
        unary[first] += by[-3]
        unary[last] += by[-2]
        return self._mean(good_lines(unary, self.pair, counts), size, counts)

    def _mean(self, good: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out, full = np.full(len(counts), np.nan), counts > 0
        at = (np.cumsum(counts) - counts)[full]
        if len(at):
            out[full] = np.add.reduceat(good * size, at) / np.add.reduceat(size, at)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        q = self.quality(texts)
        return np.where(np.isnan(q), 0.0, _sigmoid(self.slope * np.nan_to_num(q) + self.shift))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _adam(start: np.ndarray, gradient, steps: int, rate: float = 0.1) -> np.ndarray:
    """Gradient ascent with Adam's step sizes."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return w


def fit(own: np.ndarray, size: np.ndarray, counts: np.ndarray, label: np.ndarray, steps: int = 60) -> Model:
    """A model from the line features of labelled texts."""
    x = chain_features(own, counts)
    mean = x.mean(axis=0)
    spread = np.array([c.std() for c in x.T])
    mean[spread < 1e-9], spread[spread < 1e-9] = 0, 1
    x -= mean
    x /= spread
    y = np.repeat(label, counts).astype(float)
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) * np.minimum(size, 400) / 400
    w = _adam(np.zeros(x.shape[1]), lambda w: x.T @ (balance * (y - _sigmoid(x @ w))) / len(x) - 1e-3 * w, 2 * steps)
    good = np.where(y > 0, 1.0, (_sigmoid(x @ w) > CLEARLY_GOOD).astype(float))
    linked = np.ones(len(x), bool)
    linked[(np.cumsum(counts) - counts)[counts > 0]] = False
    at = np.flatnonzero(linked)
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[at - 1].astype(int), good[at].astype(int)), 1)

    def gradient(v: np.ndarray) -> np.ndarray:
        p, pairs, _ = marginals(x @ v[:-4], v[-4:].reshape(2, 2), counts)
        return np.concatenate([x.T @ (good - p), (seen - pairs).ravel()]) / len(x) - 1e-3 * v

    v = _adam(np.concatenate([w, np.zeros(4)]), gradient, steps)
    model = Model(mean, spread, v[:-4], v[-4:].reshape(2, 2), 1.0, 0.0)
    q = model._mean(good_lines(x @ model.weight, model.pair, counts), size, counts)
    full = ~np.isnan(q)
    q, y = np.column_stack([q[full], np.ones(full.sum())]), label[full].astype(float)
    even = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    slope, shift = _adam(np.array([8.0, -4.0]), lambda c: q.T @ (even * (y - _sigmoid(q @ c))) / len(y) - 1e-4 * c, 400)
    return Model(mean, spread, v[:-4], v[-4:].reshape(2, 2), float(slope), float(shift))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, sample_total: int = SAMPLE_TOTAL) -> Model | None:
    """A model from at most sample_docs documents of each class, of sample_lines lines each and sample_total a class at most; None unless both classes occur.

    labels are to be those that may be learned from, as all of them are counted. Null labels, ids and texts teach nothing; of several labels of
    an id the least counts, of several texts the first in order.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    draw = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1_000_000)) / 1e6
    drawn = known.withColumn("draw", draw)
    # sample_docs rows a class at most; those above twice the share that is expected to be enough are not sorted
    each = [drawn.where((F.col("label") == y) & (F.col("draw") < 2 * sample_docs / n)).orderBy("draw", "id").limit(sample_docs) for y, n in sorted(sizes.items())]
    chosen = each[0].unionByName(each[1])
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "id")
    lines = F.size(F.split("text", "[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"))
    rows = rows.groupBy("id", "label", "draw").agg(F.min("text").alias("text")).withColumn("lines", lines).where(F.col("lines") <= sample_lines)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, text in enumerate(batch["text"]):
                own, size, _ = line_features([text])
                at = batch.iloc[k : k + 1]
                yield pd.DataFrame({"id": at["id"], "label": at["label"], "draw": at["draw"], "own": [own.astype(np.float32).tobytes()], "size": [size.astype(np.int64).tobytes()]})

    found = rows.select("id", "label", "draw", "text").mapInPandas(features, "id long, label int, draw double, own binary, size binary").where(F.octet_length("size") > 0)
    # of the rows of a class, sample_docs at most, those that come first and have sample_total lines together
    first = Window.partitionBy("label").orderBy("draw", "id")
    kept = found.withColumn("total", F.sum(F.octet_length("size") / 8).over(first)).where(F.col("total") <= sample_total)
    got = kept.select("id", "label", "own", "size").toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    label = got.column("label").to_numpy()[order]
    if len(set(label.tolist())) < 2:
        return None
    raw = {name: got.column(name).take(pa.array(order)) for name in ("own", "size")}
    size = [np.frombuffer(x.as_buffer(), np.int64) for x in raw["size"]]
    own = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in raw["own"]]).reshape(-1, len(OWN)).astype(np.float64)
    return fit(own, np.concatenate(size).astype(np.float64), np.array([len(x) for x in size], np.int64), label)


def score(text: Column, model: Model | None) -> Column:
    """Column of scores, 0 to 1, of whole texts."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.tolist()
            if model is None:
                yield pd.Series([0.5 if t and not t.isspace() else 0.0 for t in values], dtype=float)
            else:
                yield pd.Series(np.concatenate([model.scores(x) for x in steps(values, STEP_CHARS)]) if values else [], dtype=float)

    return scores(text)


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that the contract lets the model learn from: crc32 of the id as text, modulo 5, is not 0. A null id is not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose remainder is 0; never null: a null id has none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))

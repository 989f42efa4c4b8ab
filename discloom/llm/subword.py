"""Hashed word and character n-gram vectors, averaged, with a linear softmax; numpy throughout.

A text's pieces are its whitespace-separated words, pairs of neighbouring words (a word repeated is one pair, whatever
the word) and the 3- to 5-grams of words' UTF-8 bytes, blanks marking word ends, each hashed to one of BUCKETS vectors. A
word of more than LONGEST bytes counts as several of LONGEST bytes. A window's representation is the mean of its pieces'
vectors; a softmax over two classes reads it. Vectors and softmax are trained jointly by stochastic gradient descent.

Because the softmax reads a mean, a trained model folds into one number for each bucket (its vector's share of the
logit), and scoring a window is a mean of table look-ups: the whole corpus is scored vectorised over byte positions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from discloom.llm.words import LOWER, SEPARATOR, U, powers

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
#: Words of a window.
WINDOW = 24
#: Pieces added to a window's count when windows compete, so that few pieces can't win by chance.
SHRINK = 40
#: Batches that a fit takes at least: a small sample is gone through more often.
LEAST_STEPS = 800
LONGEST = 1 << 12
#: Bytes of text handled at once; far more than a window of the longest words.
PIECE = 1 << 18


@dataclass
class Model:
    """shares: logit share of each bucket; a window's logit is gain * (mean share) + bias; blank: that of a text without words; fold: A-Z lower-cased?"""

    shares: np.ndarray
    gain: float
    bias: float
    blank: float
    fold: bool
    pooling: str


_FOLDS = {fold: bytes(32 if SEPARATOR[b] else int(LOWER[b]) if fold else b for b in range(256)) for fold in (False, True)}
_SHIFT = U(64 - BUCKETS.bit_length() + 1)
_ENDLESS, _BLANKS = re.compile(rb"[^ \t-\r]{%d}(?=[^ \t-\r])" % LONGEST), re.compile(rb"[ \t-\r]{2,}")
_down: dict[int, np.ndarray] = {}


def _salted(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(n)
    if salt not in _down or len(_down[salt]) < n:
        with np.errstate(over="ignore"):
            _down[salt] = down * (U(0xD6E8FEB86659FD93) * U(2 * salt + 1))
    return up, _down[salt]


class Pieces:
    """Pieces of texts laid end to end between blanks: grams by byte position, words by their first byte."""

    def __init__(self, texts: list[bytes], fold: bool, once: bool = False):
        """once: words that repeat the one before them hold no pieces."""
        sizes = np.array([len(t) for t in texts], np.int64)
        self.row_at = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
        self.x = np.frombuffer((b" " + b" ".join(texts) + b" " * 8).translate(_FOLDS[fold]), np.uint8)
        n = len(self.x)
        self.blank = self.x == 32
        first = ~self.blank
        first[1:] &= self.blank[:-1]
        self.starts = np.flatnonzero(first)
        self.bounds = np.searchsorted(self.starts, self.row_at)
        with np.errstate(over="ignore"):
            self.total = np.empty(n + 1, U)
            self.total[0] = 0
            np.cumsum((self.x.astype(U) + U(1)) * powers(n)[0][:n], out=self.total[1:])

            last = ~self.blank
            last[:-1] &= self.blank[1:]
            ends = np.flatnonzero(last) + 1
            self.hash = (self.total[ends] - self.total[self.starts]) * _salted(n, 0)[1][self.starts]
        self.same = np.zeros(len(self.starts), bool)
        self.same[1:] = self.hash[1:] == self.hash[:-1]
        self.lead = np.zeros(len(self.starts) + 1, bool)
        self.lead[self.bounds] = True
        self.lead = self.lead[:-1]
        self.same &= ~self.lead
        self.once = None
        if once and self.same.any():
            self.once = np.append(~self.same, True)[np.maximum(np.cumsum(first) - 1, 0)]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each word, and whether it counts."""
        return (self.hash >> _SHIFT).astype(np.int32), ~self.same if self.once is not None else np.ones(len(self.hash), bool)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each word with the one before it: a repeated word has one bucket, whatever the word."""
        with np.errstate(over="ignore"):
            h = np.zeros(len(self.hash), U)
            h[1:] = (self.hash[1:] * U(0x9FB21C651E98DF25) + self.hash[:-1]) * U(0xD6E8FEB86659FD93)
        h[self.same] = 0
        return (h >> _SHIFT).astype(np.int32), ~self.lead & (~self.same if self.once is not None else True)

    def grams(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of the gram at each position, and which positions have one: blanks may end a gram, but not lie inside."""
        n = len(self.x)
        span = n - g + 1
        word = ~self.blank
        good = word[1 : 1 + span].copy()
        for k in range(2, g - 1):
            good &= word[k : k + span]
        if self.once is not None:
            good &= self.once[1 : 1 + span]
        with np.errstate(over="ignore"):
            return (((self.total[g:] - self.total[:span]) * _salted(n, g)[1][:span]) >> _SHIFT).astype(np.int32), good


def cut_words(text: bytes) -> bytes:
    """The text with words of more than LONGEST bytes cut, and runs of blanks shortened where it is longer than PIECE."""
    if len(text) <= LONGEST:
        return text
    # a longer word covers one of these stretches whole
    half = LONGEST // 2
    if not SEPARATOR[np.frombuffer(text, np.uint8, len(text) // half * half)].reshape(-1, half).any(axis=1).all():
        text = _ENDLESS.sub(rb"\g<0> ", text)
    return _BLANKS.sub(b" ", text) if len(text) > PIECE else text


def segments(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A text of cut_words() in stretches of up to PIECE bytes that begin with a window, and how many words before it each has.

    Each stretch but the first starts with the word before its first window, so pairs and repetitions are seen as in the whole text.
    """
    before, at = None, 0
    while len(text) - at > PIECE:
        gap = SEPARATOR[np.frombuffer(text, np.uint8, PIECE, at)]
        first = ~gap
        first[1:] &= gap[:-1]
        starts = np.flatnonzero(first)
        k = (len(starts) - 1) // WINDOW * WINDOW
        stop = at + int(starts[k])
        yield text[at if before is None else before : stop], int(before is not None)
        before, at = at + int(starts[k - 1]), stop
    yield text[at if before is None else before :], int(before is not None)


def windows(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows of all rows, and the first window of each row; the last window of a row may be short."""
    counts = -(-np.diff(bounds) // width)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    return bounds[row] + (np.arange(firsts[-1]) - firsts[row]) * width, firsts


def window_sums(model: Model, texts: list[bytes], skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of shares, number of pieces) of each window, and the first window of each row. skip: words before the first window of a lone text."""
    p = Pieces(texts, model.fold, model.pooling == "max")
    starts, firsts = windows(p.bounds + np.append(skip, np.zeros(len(texts), np.int64)), WINDOW)
    if not len(starts):
        return np.empty(0), np.empty(0), firsts
    value, count = np.zeros(len(p.x) + 1), np.zeros(len(p.x) + 1, np.uint8)
    for bucket, good in (p.words(), p.pairs()):
        value[p.starts + 1] += model.shares[bucket] * good
        count[p.starts + 1] += good
    for g in GRAMS:
        bucket, good = p.grams(g)
        # a gram counts at its second byte, which lies in its word
        value[1 : 1 + len(good)] += model.shares[bucket] * good
        count[1 : 1 + len(good)] += good
    at = p.starts[starts]
    return np.add.reduceat(value, at), np.add.reduceat(count, at, dtype=np.int64).astype(float), firsts


def logits(model: Model, texts: list[bytes]) -> np.ndarray:
    """One logit for each text: of the mean over all pieces, or of its highest window; `blank` for one without words."""
    cuts = [(r, *cut) for r, t in enumerate(texts) for cut in segments(cut_words(t))]
    rows = len(texts)
    sums, counts, best = np.zeros(rows), np.zeros(rows), np.full(rows, -np.inf)
    k = 0
    while k < len(cuts):
        e, size = k + 1, len(cuts[k][1])
        while e < len(cuts) and not cuts[k][2] and not cuts[e][2] and size + len(cuts[e][1]) <= PIECE:
            size += len(cuts[e][1])
            e += 1
        s, c, firsts = window_sums(model, [t for _, t, _ in cuts[k:e]], cuts[k][2])
        live = np.flatnonzero(np.diff(firsts))
        if len(live):
            row = np.array([cuts[k + j][0] for j in live])
            np.add.at(sums, row, np.add.reduceat(s, firsts[live]))
            np.add.at(counts, row, np.add.reduceat(c, firsts[live]))
            if model.pooling == "max":
                np.maximum.at(best, row, np.maximum.reduceat(s / (c + SHRINK), firsts[live]))
        k = e
    out = np.full(rows, model.blank, float)
    full = counts > 0
    value = best if model.pooling == "max" else sums / np.maximum(counts, 1)
    out[full] = model.gain * value[full] + model.bias
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Bags:
    """Windows of training texts as bags of buckets."""

    def __init__(self, texts: list[bytes], fold: bool, width: int, once: bool):
        texts = [cut_words(t) for t in texts]
        # a byte begins at most one gram of each length, a word and a pair: room for all is taken once, and touched as it fills
        room = np.empty(sum(len(t) + 1 for t in texts) * (len(GRAMS) + 2), np.int32)
        counts, firsts, base, at, filled = [np.empty(0, np.int64)], [0], 0, 0, 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= PIECE:
                size += len(texts[end])
                end += 1
            p = Pieces(texts[at:end], fold, once)
            starts, first = windows(p.bounds, width)
            if len(starts):
                begin = p.starts[starts]
                found = [(bucket[good], p.starts[good]) for bucket, good in (p.words(), p.pairs())]
                for g in GRAMS:
                    bucket, good = p.grams(g)
                    place = np.flatnonzero(good)
                    found.append((bucket[place], place + 1))
                window = np.searchsorted(begin, np.concatenate([place for _, place in found]), side="right") - 1
                order = np.argsort(window, kind="stable")
                room[filled : filled + len(order)] = np.concatenate([b for b, _ in found])[order]
                filled += len(order)
                counts.append(np.bincount(window, minlength=len(starts)))
            firsts += (first[1:] + base).tolist()
            base += len(starts)
            at = end
        self.bucket = room[:filled]
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        self.firsts = np.array(firsts)

    def means(self, shares: np.ndarray) -> np.ndarray:
        """Mean share of each window, a stretch of windows of about 1 << 20 pieces at a time."""
        n, out, k = np.diff(self.at), np.zeros(len(self.at) - 1), 0
        while k < len(n):
            e = max(k + 1, int(np.searchsorted(self.at, self.at[k] + (1 << 20), side="right")) - 1)
            total = np.concatenate([[0], np.cumsum(shares[self.bucket[self.at[k] : self.at[e]]])])
            out[k:e] = total[self.at[k + 1 : e + 1] - self.at[k]] - total[self.at[k:e] - self.at[k]]
            k = e
        return out / np.maximum(n, 1)


def _sgd(bags: _Bags, which: np.ndarray, label: np.ndarray, weight: np.ndarray, dims: int, epochs: int, rate: float, rng: np.random.Generator, batch: int = 128) -> np.ndarray:
    """Joint stochastic descent on vectors and softmax, with steps scaled by past gradients; returns the buckets' shares."""
    vectors = rng.uniform(-0.01, 0.01, (dims, BUCKETS)).astype(np.float32)
    soft = np.zeros((2, dims), np.float32)
    soft[1] = np.where(np.arange(dims) % 2, 1, -1)
    soft[0] = -soft[1]
    seen, seen_soft = np.full(BUCKETS, 1e-8, np.float32), np.full((2, dims), 1e-8, np.float32)
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // max(1, len(which))))):
        order = rng.permutation(len(which))
        for k in range(0, len(order), batch):
            turn = order[k : k + batch]
            own = which[turn]
            sizes = bags.at[own + 1] - bags.at[own]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat = bags.bucket[np.repeat(bags.at[own] - ends[:-1], sizes) + np.arange(ends[-1])]
            inverse = (1 / np.maximum(sizes, 1)).astype(np.float32)
            hidden = np.stack([np.add.reduceat(np.append(v[flat], np.float32(0)), ends[:-1]) for v in vectors]) * ((sizes > 0) * inverse)
            z = soft @ hidden
            p = np.exp(z - z.max(axis=0))
            p /= p.sum(axis=0)
            p[label[turn], np.arange(len(own))] -= 1
            p *= weight[turn] / len(own)
            pull = p @ hidden.T
            row = np.repeat(np.arange(len(own)), sizes)
            # with two classes p[0] = -p[1]: a vector's gradient is the softmax's difference times one number for each bucket
            push = np.bincount(flat, weights=((p[1] - p[0]) * inverse / 2)[row], minlength=BUCKETS).astype(np.float32)
            seen += push * push
            step = rate * push / np.sqrt(seen)
            live = np.flatnonzero(push)
            vectors[:, live] -= (soft[1] - soft[0])[:, None] * step[live] / dims
            seen_soft += pull * pull
            soft -= 0.1 * rate * pull / np.sqrt(seen_soft)
    return ((soft[1] - soft[0]) @ vectors).astype(np.float64)


def train(texts: list[bytes], labels: np.ndarray, fold: bool, pooling: str, dims: int = 8, epochs: int = 4, rate: float = 0.2, rounds: int = 2, target: float = 0.7, seed: int = 11) -> Model:
    """A model for texts' 0/1 labels; where only one label has texts with words, every score is that label's. pooling 'mean' reads whole texts; 'max' the highest window, which a positive text is taught by.

    The logit's gain and bias come from rows that training holds back (from all, if a class would be missing), and put `target` where precision and recall balance best.
    """
    labels = np.asarray(labels).astype(int)
    rng = np.random.default_rng(seed)
    bags = _Bags(texts, fold, WINDOW if pooling == "max" else 1 << 40, pooling == "max")
    full = np.flatnonzero(np.diff(bags.firsts) > 0)
    taught = set(labels[full].tolist())
    if len(taught) < 2:
        only = 4.0 if taught == {1} else -4.0
        return Model(np.zeros(BUCKETS), 1.0, only, only, fold, pooling)
    held = rng.random(len(labels)) < 0.25
    learn, check = full[~held[full]], full[held[full]]
    if min(len(set(labels[part].tolist())) for part in (learn, check)) < 2:
        learn = check = full  # too few rows to hold any back
    ratio = np.clip((labels[learn] == 0).sum() / max(1, (labels[learn] == 1).sum()), 0.2, 5.0)
    first, last = bags.firsts[:-1], bags.firsts[1:]
    if pooling == "max":
        which = np.concatenate([np.arange(first[r], last[r]) for r in learn])
        label = np.repeat(labels[learn], (last - first)[learn])
    else:
        which, label = first[learn], labels[learn]
    for k in range(rounds if pooling == "max" else 1):
        weight = np.where(label == 1, ratio, 1.0).astype(np.float32)
        shares = _sgd(bags, which, label, weight, dims, epochs, rate, rng)
        if pooling == "max" and k + 1 < rounds:
            means = bags.means(shares)
            # a positive text teaches by its windows that look positive now, at least by its best one
            tops, names = [], []
            for r in learn:
                own = np.arange(first[r], last[r])
                if labels[r]:
                    own = own[(means[own] > 0) | (means[own] == means[own].max())]
                tops.append(own)
                names.append(np.full(len(own), labels[r]))
            which, label = np.concatenate(tops), np.concatenate(names)
    means = bags.means(shares)
    size = np.diff(bags.at).astype(float)
    if pooling == "max":
        means = means * size / (size + SHRINK)
    values = np.array([means[a:b].max() if b > a else np.nan for a, b in zip(first, last, strict=True)])
    x, y = values[check], labels[check]
    # the cut with the best F1 on the held-back rows, in the middle of its gap; the spread sets the slope
    order = np.argsort(-x)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    k = int(f1.argmax())
    below = x[order[k + 1]] if k + 1 < len(x) else x[order[k]] - 1
    cut = (x[order[k]] + below) / 2
    high, low = np.median(x[y == 1]), np.median(x[y == 0])
    gain = 6 / max(high - low, 1e-6)
    bias = float(np.log(target / (1 - target)) - gain * cut)
    return Model(shares, gain, bias, gain * low + bias, fold, pooling)

"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

Kernel. A word (lower case, with marks for its begin and end) is described by its subsequences of three characters that
span at most three plus GAP places, each weighted by DECAY to the power of its span; the kernel is the cosine of two
such descriptions. Inserted or left-out characters change some spans only, so a mangled insult stays near the plain one.
Letters that stand alone in a row are joined to a word first, which finds spelled-out insults. A word of over LENGTH characters is
read in overlapping pieces.

Landmarks. The kernel's space is approximated by its Nyström map onto at most LANDMARKS words; a linear SVM is trained there. As the
kernel is an inner product over subsequences, the trained function is folded into one table of weights by subsequence,
so that scoring a word costs a lookup per subsequence whatever the number of landmarks; distinct words are scored once per
worker while remembered.

Across spaces. Two and three neighbouring words of a sentence of at most JOINED characters together are described like one word
too, without the spaces, which finds split insults and insults of several ordinary words. Their lengths count a subsequence
that occurs in several places as several, so that all windows of a batch of texts are summed at once.

Sentences. A text is cut into sentences at line ends and behind stops that something else than a small letter follows. A
sentence is as toxic as its worst word or window, a document as its worst sentence. Labels are documents': of a toxic one the
sentence that holds its witness, the word or window that stands out most, is taken as the toxic sentence, all sentences of clean
ones as clean, and witnesses are chosen anew by the machine for some rounds. A logistic curve over documents turns the margin
into a probability. Windows have a second machine, so that what words say stays; its threshold lets ALARMS of the clean texts
learnt from pass as toxic.

Training sees at most TOXIC_SAMPLE and CLEAN_SAMPLE labelled documents, those with the smallest hashes of doc_id, and keeps at
most NEGATIVES words of clean ones and HARD of those that come close; scoring covers all texts whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, labelled_sample, table, unused
from .quality import fit_logistic
from .shingles import _power, mix, slices

GAP, DECAY, LENGTH = 2, 0.5, 24
LANDMARKS = 400
TOXIC_SAMPLE, CLEAN_SAMPLE = 2000, 4000
NEGATIVES, HARD = 12_000, 2000
#: Slots of a worker's table of words.
REMEMBERED = 1 << 19
JOINED, ALARMS = 48, 0.005
#: Words that are described together, and words whose windows are looked at together in training.
TOGETHER = 2_000
CHUNK = 20_000
#: Characters of a longer text that are scored at a time.
STRETCH = 2_000_000
_SIZE = 64**3
_EDGE = ".,;:!?\"'()[]{}#*$%&|<>~`^_-+=/\\@"
_NONE = -2.0  # a text without words
_STOP = re.compile(r"(?<=[.!?…])\s+(?=[^\sa-z])|[\n\x1e]+")


def points(text: str) -> np.ndarray:
    """Its code points."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def codes_of(chars: np.ndarray) -> np.ndarray:
    """A number below 64 of each code point: small ASCII letters have their own, others share 35; 62 and 63 mark a word's edges."""
    n = chars.astype(np.int32)
    return np.where((n >= 97) & (n <= 122), n - 96, 27 + n % 35)


def _offsets(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    places = [(i, j, k) for i in range(length) for j in range(i + 1, length) for k in range(j + 1, min(length, i + 3 + GAP))]
    i, j, k = (np.array(x, np.int64) for x in zip(*places))
    return i, j, k, DECAY ** (k - i - 2)


_places: dict[int, tuple] = {}


def pieces(word: str) -> list[str]:
    """Parts of at most LENGTH characters, overlapping by half."""
    if len(word) <= LENGTH:
        return [word]
    return [word[k : k + LENGTH] for k in range(0, len(word) - LENGTH // 2, LENGTH // 2)]


def subsequences(words: list[str]):
    """By length: (indices of words, (n, f) subsequence codes, (f,) weights); a word has at most LENGTH characters, one at least."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == n)
        if n + 2 not in _places:
            _places[n + 2] = _offsets(n + 2)
        i, j, k, weight = _places[n + 2]
        for lo in range(0, len(own), TOGETHER):
            part = own[lo : lo + TOGETHER]
            text = "".join([words[x] for x in part])
            codes = codes_of(points(text)).reshape(len(part), n)
            framed = np.full((len(part), n + 2), 62, np.int32)
            framed[:, 1:-1] = codes
            framed[:, -1] = 63
            yield part, (framed[:, i] * 64 + framed[:, j]) * 64 + framed[:, k], weight


def norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Lengths of the words' descriptions: the weights of a subsequence that occurs in several places add up."""
    out = np.full(len(codes), (weight**2).sum())
    order = np.sort(codes, axis=1)
    again = np.flatnonzero((order[:, 1:] == order[:, :-1]).any(axis=1))
    if len(again):
        order = np.argsort(codes[again], axis=1)
        sorted_ = np.take_along_axis(codes[again], order, 1)
        first = np.ones(sorted_.shape, bool)
        first[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
        starts = np.flatnonzero(first.ravel())
        total = np.add.reduceat(weight[order].ravel(), starts)
        out[again] = np.bincount(starts // codes.shape[1], total**2, len(again))
    return np.sqrt(out)


#: Length of the description of so many characters with marks, if no subsequence occurs twice.
_LENGTHS = np.sqrt([max(1.0, sum(max(0, n + 2 - d) * (d - 1) * DECAY ** (2 * (d - 2)) for d in range(2, 3 + GAP))) for n in range(JOINED + 1)])


class Machine:
    """score(words) by a table of weights over subsequences."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift
        self.short: dict[str, float] = {}
        self.joined: Machine | None = None

    @property
    def unlearnt(self) -> bool:
        """There was no text of either label, and every score is 0.5."""
        return self.slope == 0 and self.shift == 0

    def margins(self, words: list[str]) -> np.ndarray:
        parts = [(k, p) for k, w in enumerate(words) for p in pieces(w)] if any(len(w) > LENGTH for w in words) else None
        if parts is not None:
            margins = self.margins([p for _, p in parts])
            out = np.full(len(words), -np.inf)
            np.maximum.at(out, [k for k, _ in parts], margins)
            return out
        out = np.empty(len(words))
        for own, codes, weight in subsequences(words):
            out[own] = (self.weights[codes] @ weight) / norms(codes, weight) + self.bias
        return out

    def best_joined(self, texts: list[Worded]) -> list[tuple[float, str | None]]:
        """Of each text the greatest margin of two or three neighbouring words of a sentence as one, and that window; (_NONE, None) if there is none."""
        best: list[tuple[float, str | None]] = []
        held, words = [], 0
        for worded in texts:
            held.append(worded)
            words += len(worded[0])
            if words >= CHUNK:
                best += self._best_joined(held)
                held, words = [], 0
        return best + self._best_joined(held)

    def _best_joined(self, texts: list[Worded]) -> list[tuple[float, str | None]]:
        words = [w for found, _ in texts for w in found]
        owner = np.repeat(np.arange(len(texts)), np.array([len(found) for found, _ in texts], np.int64))
        sentence = np.fromiter((n for _, numbers in texts for n in numbers), np.int64, len(words)) + (owner << 40)
        joined = "".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        s, e, first, margin = self.windows(points(joined), ends - np.diff(ends, prepend=0), ends, sentence)
        best: list[tuple[float, str | None]] = [(_NONE, None)] * len(texts)
        order = np.lexsort((margin, owner[first]))
        last = order[np.flatnonzero(np.append(np.diff(owner[first][order]) > 0, len(order) > 0))]
        for k, m, a, b in zip(owner[first[last]].tolist(), margin[last].tolist(), s[last].tolist(), e[last].tolist()):
            best[k] = (m, joined[a:b]) if m > _NONE else best[k]
        return best

    def windows(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words lie one behind the other in chars, each in a sentence: (start, end, first word, margin) of all windows."""
        two, three = np.flatnonzero(sentence[1:] == sentence[:-1]), np.flatnonzero(sentence[2:] == sentence[:-2])
        s, e, first = np.concatenate([starts[two], starts[three]]), np.concatenate([ends[two + 1], ends[three + 2]]), np.concatenate([two, three])
        fits = np.flatnonzero(e - s <= JOINED)
        s, e, first = s[fits], e[fits], first[fits]
        length, margin = e - s, np.empty(len(s))
        small = np.flatnonzero(length < 4)
        padded = np.append(chars, np.zeros(3, chars.dtype)).astype(np.int64)
        packed = sum(np.where(length[small] > k, padded[s[small] + k], 0) << 21 * k for k in range(3))
        once, where = np.unique(packed, return_inverse=True)
        margin[small] = np.array([self._short("".join(chr(n >> 21 * k & 0x1FFFFF) for k in range(3) if n >> 21 * k)) for n in once.tolist()])[where]
        large = np.flatnonzero(length >= 4)
        margin[large] = self._sums(codes_of(chars), s[large], e[large]) / _LENGTHS[length[large]] + self.bias
        return s, e, first, margin

    def _sums(self, codes: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Sums of the weights of all subsequences of [s, e) with marks at its edges, four characters at least, by running sums over the text."""
        n, table, total = len(codes), self.weights, np.zeros(len(s))
        c = np.concatenate([codes, np.zeros(4, codes.dtype)])
        for d in range(2, 3 + GAP):
            inner = sum(table[(c[:n] * 64 + c[j : n + j]) * 64 + c[d : n + d]] for j in range(1, d))
            run = np.concatenate([[0.0], np.cumsum(inner)])
            part = run[np.maximum(e - d, s)] - run[s]
            for j in range(1, d):
                part += table[(62 * 64 + c[s + j - 1]) * 64 + c[s + d - 1]] + table[(c[e - d] * 64 + c[e - d + j]) * 64 + 63]
            total += DECAY ** (d - 2) * part
        return total

    def _short(self, word: str) -> float:
        if word not in self.short:
            if len(self.short) >= REMEMBERED:
                self.short.clear()
            self.short[word] = float(self.margins([word])[0])
        return self.short[word]

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


#: Words of a text in order, and the number of the sentence of each.
Worded = tuple[list[str], list[int]]


def sentences(text: str | None) -> list[str]:
    """A text's sentences in order, as they are; blank ones are none."""
    return [part for part in _STOP.split(text or "") if part.strip()]


def read(text: str | None) -> Worded:
    """Words split at white space, in small letters, by sentence."""
    words: list[str] = []
    numbers: list[int] = []
    for k, part in enumerate(_STOP.split(text or "")):
        found = part.lower().split()
        words += found
        numbers += [k] * len(found)
    return words, numbers


def words_of(text: str | None) -> list[str]:
    """Words of a text in order, and behind them lone characters in a row as words of their own."""
    return _with_lone(read(text)[0])


def _with_lone(found: list[str]) -> list[str]:
    if not _has_lone_run(found):
        return found
    lone, joined = [], []
    for w in [*found, "  "]:
        if len(w) == 1:
            lone.append(w)
        else:
            if len(lone) > 2:
                joined.append("".join(lone))
            lone = []
    return found + joined


def _has_lone_run(found: list[str]) -> bool:
    alone = np.fromiter(map(len, found), np.int64, len(found)) == 1
    return bool((alone[:-2] & alone[1:-1] & alone[2:]).any())


def bared(word: str) -> str:
    return word.strip(_EDGE) or word


def neighbours(text: str | None, known: dict[str, str] | None = None) -> Worded:
    """Words in order without marks at their edges, each once in memory if `known` is given."""
    found, numbers = read(text)
    bare = map(bared, found)
    return list(bare) if known is None else [known.setdefault(w, w) for w in bare], numbers


def _windows(worded: Worded) -> set[str]:
    words, numbers = worded
    joined = {a + b for a, b, m, n in zip(words, words[1:], numbers, numbers[1:]) if m == n}
    joined |= {a + b + c for a, b, c, m, n in zip(words, words[1:], words[2:], numbers, numbers[2:]) if m == n}
    return {w for w in joined if len(w) <= JOINED}


def _kernel_columns(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row of the table for each subsequence code, (rows, landmarks) normalised descriptions); row 0 is for codes of none."""
    entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for own, codes, weight in subsequences(landmarks):
        length = norms(codes, weight)
        entries.append((codes.ravel(), np.repeat(own, codes.shape[1]), (weight[None, :] / length[:, None]).ravel()))
    codes, column, value = (np.concatenate(x) for x in zip(*entries))
    known, row = np.unique(codes, return_inverse=True)
    matrix = np.zeros((len(known) + 1, len(landmarks)))
    np.add.at(matrix, (row + 1, column), value)
    where = np.zeros(_SIZE, np.int64)
    where[known] = np.arange(1, len(known) + 1)
    return where, matrix


def _kernel(words: list[str], where: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), matrix.shape[1]))
    for own, codes, weight in subsequences(words):
        total = np.zeros((len(own), matrix.shape[1]))
        for f in range(codes.shape[1]):
            total += weight[f] * matrix[where[codes[:, f]]]
        out[own] = total / norms(codes, weight)[:, None]
    return out


def nystroem(marks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where, matrix, map): _kernel(words, where, matrix) @ map describes words by numbers whose inner products are the kernel, exactly so
    if one of the two words is a landmark."""
    where, matrix = _kernel_columns(marks)
    values, vectors = np.linalg.eigh(_kernel(marks, where, matrix))
    good = values > 1e-6 * values.max()
    return where, matrix, vectors[:, good] / np.sqrt(values[good])


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Squared hinge loss by Newton steps; the last weight is the bias. y is 1 or -1. Sums are taken over some rows at a time."""
    n = z.shape[1] + 1
    w, ridge = np.zeros(n), np.full(n, penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        left, right = np.diag(ridge), np.zeros(n)
        for lo in range(0, len(z), TOGETHER):
            a = np.hstack([z[lo : lo + TOGETHER], np.ones((len(z[lo : lo + TOGETHER]), 1))])
            t = y[lo : lo + TOGETHER]
            wrong = t * (a @ w) < 1
            a, c, t = a[wrong], cost[lo : lo + TOGETHER][wrong], t[wrong]
            left += (a * c[:, None]).T @ a
            right += a.T @ (c * t)
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def train(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, rounds: int = 3, seed: int = 5, negatives: int = NEGATIVES, most_hard: int = HARD) -> Machine:
    """A machine from whole texts of either label. Without texts of both labels every document scores 0.5 or what its one label says."""
    once: dict[str, str] = {}  # each word once in memory
    bags, others = ([sorted({once.setdefault(p, p) for w in words_of(t) for p in pieces(bared(w))}) for t in texts] for texts in (toxic, clean))
    if not any(bags) or not any(others):
        return Machine(np.zeros(_SIZE), 0.0, 0.0, 3.0 if any(bags) else -3.0 if any(others) else 0.0)
    rng = np.random.default_rng(seed)
    inside, outside = Counter(w for b in bags for w in b), Counter(w for b in others for w in b)
    stands_out = lambda w: np.log((inside[w] + 0.5) / (len(bags) + 1)) - np.log((outside[w] + 0.5) / (len(others) + 1))
    lift = {w: stands_out(w) for w, n in inside.items() if n >= 3 or n > 0.3 * len(bags)}
    witness = [max((w for w in b if w in lift), key=lambda w: (lift[w], w), default=None) for b in bags]
    least = np.log(3)
    positive = Counter(w for w in witness if w is not None and lift[w] > least)
    if not positive:
        positive = Counter(w for w in witness if w is not None) or Counter(b[0] for b in bags if b)
    vocabulary = sorted(inside.keys() | outside.keys())
    pool = sorted(w for w in outside if w not in positive)
    pool = [pool[k] for k in rng.permutation(len(pool))[:negatives]]
    hard: list[str] = []

    def fitted() -> tuple[np.ndarray, float]:
        chosen = [w for w, _ in positive.most_common(landmarks // 2)]
        marks = chosen + hard[: landmarks // 4] + pool[: landmarks - len(chosen) - min(len(hard), landmarks // 4)]
        marks = list(dict.fromkeys(marks))
        where, matrix, onto = nystroem(marks)
        negative = list(dict.fromkeys(hard + pool))
        words = [*positive, *negative]
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        counts = np.sqrt(np.array([*positive.values()], float))
        cost = np.concatenate([counts / counts.sum() * len(words) / 2, np.full(len(negative), 0.5 * len(words) / max(1, len(negative)))])
        w = _svm(_kernel(words, where, matrix) @ onto, y, cost)
        weights = np.zeros(_SIZE)
        weights[where > 0] = (matrix @ (onto @ w[:-1]))[where[where > 0]]
        return weights, w[-1]

    for _ in range(rounds):
        machine = Machine(*fitted())
        margins = dict(zip(vocabulary, machine.margins(vocabulary).tolist()))
        best = [_best(margins, b) for b in bags]
        worst = [_best(margins, b) for b in others]
        fresh = Counter(word for m, word in best if word is not None and (m > 0 or stands_out(word) > least))
        if fresh:
            positive = fresh
        hard = [word for m, word in sorted(worst, key=lambda x: (-x[0], x[1] or "")) if word is not None and m > -0.5 and word not in positive][:most_hard]
        hard = list(dict.fromkeys(hard))
    slope, shift = _curve([m for m, _ in best], [m for m, _ in worst])
    machine = Machine(machine.weights, machine.bias, slope, shift)

    # Windows have a machine of their own, so that what words say stays. Its positives are the witnesses and, where no word tells, windows.
    order, other_order = [neighbours(t, once) for t in toxic], [neighbours(t, once) for t in clean]
    missed = [o for (m, _), o in zip(best, order) if machine.probability(m) < 0.5]
    seen = {w: n for w, n in Counter(w for o in missed for w in _windows(o)).items() if n >= 3}
    inside.update(seen)
    outside.update(w for o in other_order for w in _windows(o) if w in seen)
    positive = Counter({w: n for w, n in positive.items() if stands_out(w) > least})
    for o in missed:
        first = max((w for w in _windows(o) if w in seen), key=lambda w: (stands_out(w), w), default=None)
        if first is not None and stands_out(first) > least:
            positive[first] += 1
    if not positive:
        return machine
    beside = sorted({w for o in other_order for w in rng.permutation(sorted(_windows(o)))[:4].tolist()} - positive.keys())
    hard, pool = [w for w in hard if w not in positive], pool[: negatives // 2] + [beside[k] for k in rng.permutation(len(beside))[: negatives // 2]]
    for _ in range(rounds):
        joined = Machine(*fitted())
        worst = joined.best_joined(other_order)
        hard = list(dict.fromkeys(hard + [w for m, w in sorted(worst, key=lambda x: (-x[0], x[1] or "")) if w is not None and m > -0.5 and w not in positive]))[: 2 * most_hard]
    # The windows of few clean texts may count as toxic.
    alarms = [m for m, _ in worst]
    joined.slope, joined.shift = _curve([m for m, _ in joined.best_joined(order)], alarms)
    joined.shift = min(joined.shift, -joined.slope * float(np.quantile(alarms, 1 - ALARMS) + 1e-6))
    machine.joined = joined
    return machine


def _curve(toxic: list[float], clean: list[float]) -> tuple[float, float]:
    """Slope and shift of the logistic curve over the margins of toxic and clean texts."""
    margin = np.clip(np.array(toxic + clean), -3, 3)
    label = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    mean, scale, curve = fit_logistic(margin[:, None], label, ridge=1e-3)
    slope = curve[0] / scale[0]
    return float(max(slope, 1e-3)), float(curve[1] - slope * mean[0])


def _best(margins: dict[str, float], words: list[str]) -> tuple[float, str | None]:
    word = max(words, key=margins.__getitem__, default=None)
    return (_NONE, None) if word is None else (margins[word], word)


_SPACE = np.array([chr(n).isspace() for n in range(0x3001)] + [False])
_EDGES = np.zeros(len(_SPACE), bool)
_EDGES[[ord(c) for c in _EDGE]] = True


class Scorer:
    """Texts -> probabilities, in arrays over a batch. Margins of words are remembered in a table of fixed size, by their hashes."""

    def __init__(self, machine: Machine, slots: int = REMEMBERED):
        self.machine = machine
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.known, self.margin = np.zeros(slots, np.uint64), np.zeros(slots)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        parts = [(k, part) for k, t in enumerate(texts) for part in ([t] if len(t or "") <= STRETCH else _stretches(t))]
        out = np.zeros(len(texts))
        np.maximum.at(out, [k for k, _ in parts], self._scored([part for _, part in parts]))
        return out

    def _scored(self, texts: list[str | None]) -> np.ndarray:
        """Texts are parted by \\x1d and sentences by \\x1e, which are white space like others."""
        raw = "\x1d".join(_STOP.sub("\x1e", t.replace("\x1d", " ")) if t else "" for t in texts).lower()
        chars = points(raw)
        small = np.minimum(chars, len(_SPACE) - 1)
        inside = np.zeros(len(chars) + 2, bool)
        inside[1:-1] = ~_SPACE[small]
        flips = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = flips[0::2], flips[1::2]
        owner = np.searchsorted(np.flatnonzero(chars == 0x1D), starts)
        best = np.full(len(texts), _NONE)
        best[owner] = -np.inf
        np.maximum.at(best, owner, self._words(raw, chars, starts, ends))
        for k, more in self._lone(raw, starts, ends, owner):
            best[k] = max(best[k], float(self.machine.margins(more).max()))
        score = self.machine.probability(best)
        joined = self.machine.joined
        if joined is None or not len(starts):
            return score
        solid = np.flatnonzero(inside[1:-1] & ~_EDGES[small])
        i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
        bare = np.flatnonzero(j >= i)
        starts[bare], ends[bare] = solid[i[bare]], solid[j[bare]] + 1
        size = ends - starts
        stops = np.cumsum(size)
        close = chars[np.repeat(starts - (stops - size), size) + np.arange(stops[-1])]
        sentence = np.searchsorted(np.flatnonzero((chars == 0x1D) | (chars == 0x1E)), starts)
        _, _, first, margin = joined.windows(close, stops - size, stops, sentence)
        best = np.full(len(texts), _NONE)
        np.maximum.at(best, owner[first], margin)
        return np.maximum(score, joined.probability(best))

    def _words(self, raw: str, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = _power(len(chars) + 1)
        prefix = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(0x9E3779B9)) * up[: len(chars)], out=prefix[1:])
        hashes = mix((prefix[ends] - prefix[starts]) * down[starts]) | np.uint64(1)
        slot = (hashes >> self.shift).astype(np.int64)
        margin = self.margin[slot]
        lost = np.flatnonzero(self.known[slot] != hashes)
        if len(lost):
            _, at, group = np.unique(hashes[lost], return_index=True, return_inverse=True)
            at = lost[at]
            fresh = self.machine.margins([bared(raw[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            margin[lost] = fresh[group]
            self.known[slot[at]], self.margin[slot[at]] = self._settled(slot[at], hashes[at], fresh)
        return margin

    @staticmethod
    def _settled(slot: np.ndarray, hashes: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words that share a slot the first is kept, in both arrays."""
        _, first, group = np.unique(slot, return_index=True, return_inverse=True)
        return hashes[first][group], fresh[first][group]

    @staticmethod
    def _lone(raw: str, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray):
        """(text, words) of the texts that have three lone characters in a row."""
        one = ends - starts == 1
        row = one[:-2] & one[1:-1] & one[2:] & (owner[:-2] == owner[2:])
        for k in np.unique(owner[:-2][row]).tolist():
            found = [raw[a:b] for a, b in zip(*(x[slice(*np.searchsorted(owner, (k, k + 1)))].tolist() for x in (starts, ends)))]
            yield k, [bared(w) for w in _with_lone(found)[len(found) :]]


def _stretches(text: str):
    """A long text in parts that end between words and share two of them."""
    at = 0
    while at < len(text):
        stop = at + STRETCH
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        part = text[at:stop]
        yield part
        kept_ = part.rsplit(None, 2)[0] if stop < len(text) else part
        at = at + len(kept_) if stop < len(text) and 0 < len(kept_) < len(part) else stop


def _packed(machine: Machine) -> tuple:
    own = (machine.weights.astype(np.float32).tobytes(), float(machine.bias), machine.slope, machine.shift)
    return own if machine.joined is None else (*own, _packed(machine.joined))


def _unpacked(packed: tuple) -> Machine:
    machine = Machine(np.frombuffer(packed[0], np.float32).astype(np.float64), *packed[1:4])
    machine.joined = _unpacked(packed[4]) if len(packed) > 4 else None
    return machine


def _scored(packed: tuple, key: str, name: str):
    def run(stream):
        scorer = kept(("scorer", key), lambda: Scorer(_unpacked(packed)))
        for batch in stream:
            score = [scorer(texts) for _, _, texts in slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(score) if score else np.zeros(0))], names=[*batch.schema.names, name])

    return run


def _held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine for docs(doc_id, text) and labels(doc_id, toxic); rows whose crc32(doc_id) mod 5 is 0 are not learnt from."""
    known = labels.where("doc_id is not null and toxic is not null").where(~_held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    texts = []
    for label, most in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE)):
        picked = labelled_sample(docs.where("text is not null"), known.where(F.col("label") == label), most)
        texts.append([r.text for r in picked.orderBy(F.xxhash64("doc_id"), "doc_id").select("text").collect()])
    return train(*texts)


def scored(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """docs(doc_id, text, ...) with all its columns and the score as `name`, one row per row.

    Null, empty and blank texts have the score of a text without words. A doc_id with several labels counts as toxic if
    one says so. Null doc_ids are scored, not learnt from. Repeated rows score alike; an empty table gives none. A column
    of docs that is called `name` is replaced. Very long texts are scored whole; texts whose worst words are equal tie.
    """
    docs = docs.drop(name)
    return _scored_by(trained(docs, labels), docs, name)


def _scored_by(machine: Machine, docs: DataFrame, name: str) -> DataFrame:
    import uuid

    packed = _packed(machine)
    full = type(docs.schema)([*docs.schema.fields]).add(name, "double")
    return docs.mapInArrow(_scored(packed, uuid.uuid4().hex, name), full)


def toxic_sentences(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, sentence_no, sentence, sentence_score) of the sentences that score one half or more; numbers
    count from 0 in the text, blank sentences too.

    Null, empty and blank texts have none. Repeated rows give their sentences each time; null doc_ids are kept. Very long texts are cut
    like others. Other columns are ignored. Without usable labels, and of an empty table, there are none.
    """
    import uuid

    machine = trained(docs, labels)
    packed, key = _packed(machine), uuid.uuid4().hex

    def run(stream):
        scorer = kept(("scorer", key), lambda: Scorer(_unpacked(packed)))
        for batch in stream:
            ids = batch.column(0).to_pylist()
            for lo, hi, texts in slices(batch.column(1)):
                parts = [(i, k, part) for i, text in zip(ids[lo:hi], texts) for k, part in enumerate(_STOP.split(text or "")) if part.strip()]
                score = scorer([part for *_, part in parts]) if parts else np.zeros(0)
                found = [(*parts[n], float(score[n])) for n in np.flatnonzero(score >= 0.5)]
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, row)) for row in found], schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("sentence_no", pa.int32()), ("sentence", pa.string()), ("sentence_score", pa.float64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (rows.limit(0) if machine.unlearnt else rows).mapInArrow(run, "doc_id long, sentence_no int, sentence string, sentence_score double")


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def harmless_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below one half, with their columns, whatever those are named; all rows if no label is usable.

    Null, empty and blank texts stay, and so do null doc_ids of harmless texts. Repeated rows stay or go together; a text that scores
    exactly one half goes. Very long texts are scored whole. An empty table gives none.
    """
    (name,) = unused(docs, "score")
    machine = trained(docs, labels)
    if machine.unlearnt:
        return docs
    return _scored_by(machine, docs, name).where(F.col(name) < 0.5).select(docs.columns)

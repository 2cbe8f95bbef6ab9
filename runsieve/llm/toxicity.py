"""Toxic documents by a subsequence string kernel and Nystroem landmarks.

A string is described by its subsequences of three characters that span at most
five, each with a weight that falls with the gaps in it. Two strings are alike
by the inner product of these descriptions over a norm that depends on their
lengths. An insult with characters put in between keeps most subsequences of the
plain one, so it stays close to it.

The machine learns from labelled sentences. A sentence has the label of its
documents, and is clean where any of them is clean; copies of a sentence count
once, so a much copied document weighs no more than another. Its strings, the
words, are learned from with the numbers of toxic and clean sentences they occur
in. Landmarks are the words that speak most for toxicity and the most frequent
others; in the space that their kernel matrix spans a linear support vector
machine with weighted examples is trained.

A document is judged by its most toxic word, or run of single characters read as
one word, and by the sum of the margins of all its different toxic ones. Each word is also tried without what is not a letter. Two words next
to each other, with nothing but space between, are one string more, which counts
where the machine puts it on the toxic side; those that an upper bound of the
margin keeps off that side, or that are longer than any toxic landmark by more
than ``PAIR_SLACK``, are not computed further. Each of the two is made a probability
by logistic regression on whole training documents; the higher one is the score,
so that one clear insult is enough, and so are several weak ones.

Training uses a bounded sample: at most ``TRAIN_DOCUMENTS`` labelled documents
of each label, those with the smallest hash of their key. Everything else covers
all rows and whole texts.

Defined cases: null and empty texts have no words and get the score of the least
toxic margin; contradicting labels of one key count as their mean, rounded half
up; without training documents of both labels every score is the share of toxic
ones, one half added to either count; repeated rows get equal scores; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsieve.llm.common import held_out, labels_of, map_batches, score_column, text_slices

THRESHOLD = 0.5
#: Bound of the training sample, per label.
TRAIN_DOCUMENTS = 2500
LANDMARKS_TOXIC, LANDMARKS_CLEAN = 128, 32
#: Weight of all gapped forms of a landmark together, against its own.
GAPPED_SHARE = 2.0
#: Characters put into the landmarks in training.
GAP_MARKS = "x*"
DECAY = 0.7
#: Kernel values below this towards every landmark count as zero in training.
FAR = 0.02
#: (distance of the second, of the third character) of a subsequence.
_GAPS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_WEIGHTS = tuple(DECAY ** (last - 2) for _, last in _GAPS)
#: Characters that a pair of words may have beyond the longest toxic landmark.
PAIR_SLACK = 2
_CODES = 64
_SPAN = 32
_ROWS = 1000
#: The kernel is this power of the likeness, which sets single words apart.
DEGREE = 3
#: Groups of landmarks in the upper bound for pairs.
_GROUPS = 8
#: Distinct words, and distinct pairs, kept before a task forgets them.
_CACHE_WORDS = 300_000
#: Characters of texts that are worked on at once.
_CHARS = 1_000_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_SENTENCE = re.compile(r"[.!?\n]+")
_LONE = 3
_MODEL = pa.schema(
    [
        ("words", pa.list_(pa.string())),
        ("weights", pa.list_(pa.float64())),
        ("offset", pa.float64()),
        ("slopes", pa.list_(pa.float64())),
        ("shifts", pa.list_(pa.float64())),
    ]
)


def _codes(words: list[str], length: int) -> np.ndarray:
    """Character codes below 64 of words of one length, with edges marked."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), length)
    code = np.where((flat >= 97) & (flat <= 122), flat - 96, 27 + flat % 36)
    out = np.zeros((len(words), length + 2), dtype=np.int64)
    out[:, 1:-1] = code
    out[:, -1] = _CODES - 1
    return out


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        out.setdefault(len(word), []).append(at)
    return out


def _numbers(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Numbers of the subsequences of each gap pattern, and their weight."""
    for (second, third), weight in zip(_GAPS, _WEIGHTS):
        n = codes.shape[1] - third
        if n > 0:
            yield (codes[:, :n] * _CODES + codes[:, second : second + n]) * _CODES + codes[:, third:], weight


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: places of the words, subsequence numbers, their weights."""
    for length, places in _by_length(words).items():
        if not length:
            continue
        found = list(_numbers(_codes([words[at] for at in places], length)))
        weights = [weight for numbers, weight in found for _ in range(numbers.shape[1])]
        yield np.array(places), np.concatenate([n for n, _ in found], axis=1), np.array(weights)


class Landmarks:
    """Kernel values of any words against fixed ones.

    Only subsequences of the landmarks matter: ``place`` numbers them, and row
    by row ``table`` has what each adds to the product with every landmark.
    """

    def __init__(self, words: list[str]):
        self.words = list(words)
        rows: list[dict[int, float]] = [{} for _ in words]
        for places, numbers, weights in subsequences(words):
            scaled = (weights / np.sqrt((weights**2).sum())).tolist()
            for at, row in zip(places.tolist(), numbers.tolist()):
                for number, weight in zip(row, scaled):
                    rows[at][number] = rows[at].get(number, 0.0) + weight
        self.place = np.full(_CODES**3, -1, dtype=np.int32)
        numbers = sorted({number for row in rows for number in row})
        self.place[numbers] = np.arange(len(numbers))
        self.table = np.zeros((len(numbers), len(words)), dtype=np.float32)
        for at, row in enumerate(rows):
            self.table[self.place[list(row)], at] = list(row.values())

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.table.shape[1]), dtype=np.float32)
        for places, numbers, weights in subsequences(words):
            scaled = (weights / np.sqrt((weights**2).sum())).astype(np.float32)
            for at in range(0, len(places), _ROWS):
                column = self.place[numbers[at : at + _ROWS]].T
                like, part = np.zeros((2, column.shape[1], out.shape[1]), dtype=np.float32)
                for number, weight, after in zip(column, scaled, [*scaled[1:], None]):
                    row = np.flatnonzero(number >= 0)
                    part[row] += self.table[number[row]]
                    if weight != after:
                        like += part * weight
                        part[:] = 0
                out[places[at : at + _ROWS]] = like
        return _power(out)


def _power(likeness: np.ndarray) -> np.ndarray:
    wide = likeness.astype(np.float64)
    out = wide.copy()
    for _ in range(DEGREE - 1):
        out *= wide
    return out.astype(np.float32)


class PairBound:
    """Upper bounds of the margin of two strings written as one, from parts of either.

    Landmarks that are alike make a group; in each the bound takes all likenesses
    but one at the largest. Before the norm it is made of sums over subsequences:
    those inside the first string and its edge, those inside the second, and those
    across, which depend on the last four codes of the first and the first four of
    the second.
    """

    #: Places of a subsequence across in the four codes before and after the border.
    _ACROSS = [
        (p, p + second, p + third, weight)
        for (second, third), weight in zip(_GAPS, _WEIGHTS)
        for p in range(max(0, 4 - third), 4)
    ]

    def __init__(self, landmarks: Landmarks, weights: np.ndarray):
        toxic = np.flatnonzero(weights > 0)
        group = self._groups(landmarks.kernel([landmarks.words[at] for at in toxic])[:, toxic])
        n = len(landmarks.table)
        # The last row is for subsequences that no landmark has.
        self.place = np.append(np.where(landmarks.place < 0, n, landmarks.place), n).astype(np.int32)
        self.sums = np.zeros((n + 1, 2 * _GROUPS), dtype=np.float32)
        for at in range(_GROUPS):
            own = toxic[group == at]
            if len(own):
                self.sums[:n, at] = landmarks.table[:, own].max(axis=1)
                self.sums[:n, _GROUPS + at] = landmarks.table[:, own] @ weights[own]

    @staticmethod
    def _groups(alike: np.ndarray) -> np.ndarray:
        """Group of each landmark: that of the leader most like it; leaders are far apart."""
        leaders = [0] if len(alike) else []
        while leaders and len(leaders) < min(_GROUPS, len(alike)):
            leaders.append(int(alike[leaders].max(axis=0).argmin()))
        return alike[leaders].argmax(axis=0) if leaders else np.zeros(0, int)

    def parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per word: bound alone; sums and four codes as first string of a pair; the same as second."""
        alone = np.zeros(len(words))
        sums = np.zeros((2, len(words), self.sums.shape[1]), dtype=np.float32)
        border = np.full((2, len(words), 4), -1, dtype=np.int16)
        for length, places in _by_length(words).items():
            codes = _codes([words[at] for at in places], length)
            total, head, tail = np.zeros((3, len(places), sums.shape[2]), dtype=np.float32)
            for numbers, weight in _numbers(codes):
                found = self.place[numbers]
                for at, number in enumerate(found.T):
                    row = np.flatnonzero(number < len(self.sums) - 1)
                    added = self.sums[number[row]] * np.float32(weight)
                    total[row] += added
                    # A first string of a pair has no edge behind it, a second none before.
                    if at == 0:
                        head[row] += added
                    if at == found.shape[1] - 1:
                        tail[row] += added
            alone[places] = self._bound(total, np.full(len(places), length))
            sums[0, places], sums[1, places] = total - tail, total - head
            kept = min(4, length + 1)
            border[0, places, 4 - kept :] = codes[:, length + 1 - kept : length + 1]
            border[1, places, :kept] = codes[:, 1 : 1 + kept]
        return alone, sums[0], border[0], sums[1], border[1]

    def _bound(self, total: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        wide = lengths + 2
        square = sum(np.maximum(wide - third, 0) * weight**2 for (_, third), weight in zip(_GAPS, _WEIGHTS))
        total = total / np.sqrt(np.maximum(square, 1e-9))[:, None]
        most, up = total[:, :_GROUPS], total[:, _GROUPS:]
        return (most ** (DEGREE - 1) * up).sum(axis=1) * 1.001 + 1e-5

    def of(self, own: np.ndarray, border: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``own`` sums of both strings, the eight codes at the border, total lengths."""
        total = own.copy()
        codes = border.astype(np.int32)
        for a, b, c, weight in self._ACROSS:
            number = (codes[:, a] * _CODES + codes[:, b]) * _CODES + codes[:, c]
            number[(codes[:, a] < 0) | (codes[:, c] < 0)] = _CODES**3
            number = self.place[number]
            row = np.flatnonzero(number < len(self.sums) - 1)
            total[row] += self.sums[number[row]] * np.float32(weight)
        return self._bound(total, lengths)


def pieces(token: str) -> list[str]:
    """Strings to try for a token: as it is, letters only, in windows if long."""
    plain = token.strip(_EDGES)
    if len(plain) <= _SPAN // 2 and plain.isalpha():
        return [plain]
    letters = "".join(c for c in plain if c.isalpha())
    out = []
    for text in dict.fromkeys((plain, letters)):
        out += [text[at : at + _SPAN] for at in range(0, max(1, len(text) - _SPAN // 2), _SPAN // 2)]
    return [text for text in out if text]


def lone_runs(tokens: list[str], lone: np.ndarray) -> list[str]:
    """Runs of single characters, each as one string; ``lone`` marks those tokens."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], lone.astype(np.int8), [0]))))
    ends = zip(edges[::2].tolist(), edges[1::2].tolist())
    return ["".join(tokens[start:end]) for start, end in ends if end - start >= _LONE]


def tokens_of(text: str) -> list[str]:
    """Lower-cased tokens; runs of single characters are one more token."""
    tokens = text.lower().split()
    lone = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) == 1
    return tokens + lone_runs(tokens, lone)


class Machine:
    """Landmarks with their weights, an offset, and the logistic calibration.

    What was found out about words and pairs is kept, until more than
    ``_CACHE_WORDS`` of either are known.
    """

    def __init__(
        self,
        landmarks: Landmarks | None,
        weights: np.ndarray | None,
        offset: float,
        slopes: list[float],
        shifts: list[float],
    ):
        self.landmarks, self.weights, self.offset = landmarks, weights, offset
        self.slopes, self.shifts = slopes, shifts
        self._words = None

    def __getstate__(self):
        return self.__dict__ | {"_words": None}

    def margins(self, words: list[str]) -> np.ndarray:
        return self.landmarks.kernel(words) @ self.weights + self.offset

    def word_margins(self, words: list[str]) -> np.ndarray:
        """The largest margin among the strings to try for each word."""
        parts = [pieces(word) for word in words]
        out = np.full(len(words), self.offset)
        found = self.margins([part for own in parts for part in own])
        owner = np.repeat(np.arange(len(words)), [len(own) for own in parts])
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        if len(first):
            out[owner[first]] = np.maximum.reduceat(found, first)
        return out

    def document_margins(self, texts: list[str]) -> np.ndarray:
        """Per text the largest margin of its strings, and the logarithm of 1 plus
        the sum of those above 0, each different string once."""
        out = np.empty((len(texts), 2))
        start, size = 0, 0
        for at, text in enumerate(texts, start=1):
            size += len(text)
            if size > _CHARS or at == len(texts):
                out[start:at] = self._margins_of(texts[start:at])
                start, size = at, 0
        return out

    def _margins_of(self, texts: list[str]) -> np.ndarray:
        if self._words is None or self._words.full():
            self._words = KnownWords(self)
        known = self._words
        split = [text.lower().split() for text in texts]
        owner = np.repeat(np.arange(len(texts)), [len(tokens) for tokens in split])
        tokens = [token for own in split for token in own]
        ids = known.ids(tokens)
        best, total = np.full(len(texts), self.offset), np.zeros(len(texts))
        if not len(ids):
            return np.stack([best, total], axis=1)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        sizes = np.diff(np.append(first, len(ids)))
        # The word of the highest bound in each text, then all that may still be above it or toxic.
        upper = known.upper[ids]
        highest = np.flatnonzero(upper == np.repeat(np.maximum.reduceat(upper, first), sizes))
        known.settle(ids[highest], tokens, highest)
        least = np.repeat(np.maximum.reduceat(known.margin[ids], first), sizes)
        open_words = np.flatnonzero(upper > np.minimum(least, 0))
        known.settle(ids[open_words], tokens, open_words)
        margin = known.margin[ids]
        best[owner[first]] = np.maximum(self.offset, np.maximum.reduceat(margin, first))
        toxic = np.flatnonzero(margin > 0)
        _, once = np.unique(owner[toxic] << 32 | ids[toxic], return_index=True)
        np.add.at(total, owner[toxic][once], margin[toxic][once])
        lone = known.size[ids] == 1
        for at in np.unique(owner[lone]).tolist():
            runs = list(dict.fromkeys(lone_runs(split[at], lone[owner == at])))
            if runs:
                found = self.word_margins(runs)
                best[at] = max(best[at], found.max())
                total[at] += found[found > 0].sum()
        at, pair, margin = known.toxic_pairs(tokens, ids, owner)
        np.maximum.at(best, owner[at], margin)
        _, once = np.unique(np.stack([owner[at], pair]), axis=1, return_index=True)
        np.add.at(total, owner[at][once], margin[once])
        return np.stack([best, np.log1p(total)], axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.landmarks is None:
            return np.full(len(texts), self.shifts[0])
        value = (self.document_margins(texts) * self.slopes + self.shifts).max(axis=1)
        return 1 / (1 + np.exp(-np.clip(value, -500, 500)))


class KnownWords:
    """Numbered words with bounds of their margins, and what pairs of them need.

    ``margin`` is minus infinity until :meth:`settle` has computed it.
    """

    def __init__(self, machine: Machine):
        self.machine = machine
        self.bound = PairBound(machine.landmarks, machine.weights)
        toxic = [len(word) for word, weight in zip(machine.landmarks.words, machine.weights) if weight > 0]
        self.longest = max(toxic, default=0) + PAIR_SLACK
        self.number: dict[str, int] = {}
        self.pairs: dict[int, float] = {}
        self.margin, self.upper, self.size = np.zeros(0), np.zeros(0), np.zeros(0, np.int32)
        # As first and as second of a pair: usable, length without its outer edge, sums, codes.
        self.sides = [(np.zeros(0, bool), np.zeros(0, np.int32), np.zeros((0, 2 * _GROUPS), np.float32), np.zeros((0, 4), np.int16))] * 2

    def full(self) -> bool:
        return max(len(self.number), len(self.pairs)) > _CACHE_WORDS

    def ids(self, tokens: list[str]) -> np.ndarray:
        number = self.number
        missing = [token for token in dict.fromkeys(tokens) if token not in number]
        if missing:
            number.update(zip(missing, range(len(number), len(number) + len(missing))))
            self._learn(missing)
        return np.fromiter(map(number.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def _learn(self, words: list[str]) -> None:
        cores = [word.strip(_EDGES) for word in words]
        # Letters between edges are the only string to try; other words are settled when met.
        plain = np.array([core.isalpha() and len(core) <= _SPAN // 2 for core in cores], bool)
        alone, *sides = self.bound.parts([core if ok else "" for ok, core in zip(plain, cores)])
        upper = np.where(plain, alone + self.machine.offset, np.inf)
        short = np.array([len(word) <= self.longest + 2 for word in words], bool)
        for side, inner in enumerate((-1, 0)):
            own, border = sides[2 * side : 2 * side + 2]
            usable = short & np.array([word[inner].isalnum() for word in words], bool)
            length = np.array([len(core) for core in cores], np.int32)
            odd = np.flatnonzero(usable & ~plain)
            if len(odd):
                cut = [words[at].rstrip(_EDGES) if side else words[at].lstrip(_EDGES) for at in odd.tolist()]
                found = self.bound.parts(cut)
                own[odd], border[odd] = found[1 + 2 * side], found[2 + 2 * side]
                length[odd] = [len(word) for word in cut]
            self.sides[side] = tuple(map(np.concatenate, zip(self.sides[side], (usable, length, own, border))))
        self.upper = np.concatenate([self.upper, upper])
        self.margin = np.concatenate([self.margin, np.full(len(words), -np.inf)])
        self.size = np.concatenate([self.size, np.array([len(word) for word in words], np.int32)])

    def settle(self, ids: np.ndarray, tokens: list[str], places: np.ndarray) -> None:
        """Compute the margins of words, which stand at ``places``, that have none yet."""
        fresh = self.margin[ids] == -np.inf
        own, at = np.unique(ids[fresh], return_index=True)
        if len(own):
            self.margin[own] = self.machine.word_margins([tokens[p] for p in places[fresh][at].tolist()])
            self.upper[own] = self.margin[own]

    def toxic_pairs(self, tokens: list[str], ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of tokens toxic as one string with the next of their text, numbers of the pairs, margins.

        Only neighbours with nothing but space between them, not longer than
        ``longest``; those the bound keeps off the toxic side are not computed.
        """
        (ends, left, own1, before), (starts, right, own2, after) = self.sides
        one, two = ids[:-1], ids[1:]
        short = self.size[one] + self.size[two] <= self.longest + 2
        at = np.flatnonzero(
            (owner[:-1] == owner[1:]) & ends[one] & starts[two] & short & (left[one] + right[two] <= self.longest)
        )
        near = []
        for some in np.array_split(at, len(at) // 100_000 + 1):
            a, b = ids[some], ids[some + 1]
            border = np.concatenate([before[a], after[b]], axis=1)
            bound = self.bound.of(own1[a] + own2[b], border, left[a] + right[b])
            near.append(some[bound + self.machine.offset > 0])
        at = np.concatenate(near)
        key = ids[at] << 32 | ids[at + 1]
        keys, first, back = np.unique(key, return_index=True, return_inverse=True)
        missing = [(k, p) for k, p in zip(keys.tolist(), at[first].tolist()) if k not in self.pairs]
        if missing:
            whole = [(tokens[p] + tokens[p + 1]).strip(_EDGES) for _, p in missing]
            self.pairs.update(zip((k for k, _ in missing), self.machine.margins(whole).tolist()))
        margin = np.array([self.pairs[k] for k in keys.tolist()])[back] if len(keys) else np.zeros(0)
        toxic = margin > 0
        return at[toxic], key[toxic], margin[toxic]


def sentence_counts(texts: list[str], toxic: list[int]) -> tuple[Counter, Counter]:
    """Words by the number of distinct toxic and clean sentences they occur in."""
    label: dict[str, int] = {}
    for text, mark in zip(texts, toxic):
        for sentence in _SENTENCE.split(text.lower()):
            key = " ".join(sentence.split())
            label[key] = min(mark, label.get(key, 1))
    bad, good = Counter(), Counter()
    for sentence, mark in label.items():
        words = {part for token in tokens_of(sentence) for part in pieces(token)[:1]}
        (bad if mark else good).update(words)
    return bad, good


def support_vectors(
    x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, penalty: float = 1e-6, rounds: int = 20
) -> tuple[np.ndarray, float]:
    """Weighted linear machine with squared hinge loss, by Newton steps.

    ``toxic`` and ``clean`` are the weights of a row as example of either label.
    """
    rows = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    total = toxic.sum() + clean.sum()
    up, down = toxic / total, clean / total
    ridge = np.full(rows.shape[1], penalty)
    ridge[-1] = penalty * 1e-3
    w = np.zeros(rows.shape[1])
    for _ in range(rounds):
        f = rows @ w
        pull, push = np.where(f < 1, up, 0.0), np.where(f > -1, down, 0.0)
        inside = np.flatnonzero(pull + push)
        curve, slope = np.diag(ridge), np.zeros(len(ridge))
        for at in range(0, len(inside), 10_000):
            part = inside[at : at + 10_000]
            own = rows[part].astype(float)
            curve += (own * (pull + push)[part][:, None]).T @ own
            slope += (pull - push)[part] @ own
        after = np.linalg.solve(curve, slope)
        moved = np.abs(after - w).max()
        w = after
        if moved < 1e-5:
            break
    return w[:-1], float(w[-1])


def calibrated(margin: np.ndarray, toxic: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Logistic regression of the label on the margin, by Newton steps."""
    rows = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.zeros(2)
    ridge = np.array([1e-5, 1e-7]) * len(margin)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (p - toxic) + ridge * w
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + np.diag(ridge)
        move = np.linalg.solve(curve, slope)
        w = w - move
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _gapped(word: str) -> list[str]:
    return [word[:at] + mark + word[at:] for at in range(1, len(word)) for mark in GAP_MARKS]


def train(texts: list[str], toxic: list[int]) -> Machine:
    """Learn landmarks, machine and calibration from labelled documents."""
    marks = np.array(toxic, dtype=float)
    if not len(marks) or marks.min() == marks.max():
        return Machine(None, None, 0.0, [], [(float(marks.sum()) + 0.5) / (len(marks) + 1)])
    bad, good = sentence_counts(texts, toxic)
    words = sorted(set(bad) | set(good))
    up = np.array([bad[word] for word in words], dtype=float)
    down = np.array([good[word] for word in words], dtype=float)
    balance = up.sum() / max(1.0, down.sum())
    expected = (up + down) * up.sum() / (up.sum() + down.sum())
    excess = (up - expected) / np.sqrt(expected + 1)
    chosen = np.argsort(-excess, kind="stable")[:LANDMARKS_TOXIC].tolist()
    chosen += np.argsort(-down, kind="stable")[:LANDMARKS_CLEAN].tolist()
    fixed = [words[at] for at in dict.fromkeys(chosen)]
    landmarks = Landmarks(fixed)
    values, vectors = np.linalg.eigh(landmarks.kernel(fixed).astype(float))
    usable = values > 1e-6 * values[-1]
    to_space = vectors[:, usable] / np.sqrt(values[usable])

    # Toxic landmarks are also shown with a character put in, at a share of their weight.
    first = [words[at] for at in chosen[:LANDMARKS_TOXIC]]
    gapped = {word: _gapped(word) for word in first if len(word) > 3}
    shown = words + [variant for variants in gapped.values() for variant in variants]
    shares = [
        GAPPED_SHARE * bad[word] / len(variants) for word, variants in gapped.items() for _ in variants
    ]
    up = np.concatenate([up, shares])
    down = np.concatenate([down, np.zeros(len(shares))])
    down = 3 * balance * down
    # Words unlike all landmarks lie next to the origin and count as one row there.
    near, rows = [], []
    for at in range(0, len(shown), _ROWS):
        values = landmarks.kernel(shown[at : at + _ROWS])
        close = np.flatnonzero(values.max(axis=1) >= FAR)
        near.append(values[close])
        rows.append(at + close)
    close = np.concatenate(rows)
    x = np.vstack([part @ to_space.astype(np.float32) for part in near] + [np.zeros((1, to_space.shape[1]), np.float32)])
    up, down = (np.append(part[close], part.sum() - part[close].sum()) for part in (up, down))
    w, offset = support_vectors(x, up, down)
    machine = Machine(landmarks, to_space @ w, offset, [], [])
    found = [calibrated(column, marks) for column in machine.document_margins(texts).T]
    machine.slopes, machine.shifts = map(list, zip(*found))
    return machine


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    label_key: str = "doc_id",
) -> Machine:
    """Train on the bounded sample, in one task, with labels that are not held out."""
    known = labels_of(labels, label, label_key).filter(~held_out("labelled", 0))
    drawn = [
        known.filter(F.col("label") == mark).orderBy(F.xxhash64("labelled"), "labelled").limit(TRAIN_DOCUMENTS)
        for mark in (0, 1)
    ]
    # At most twice TRAIN_DOCUMENTS keys.
    few = F.broadcast(drawn[0].union(drawn[1]))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    sample = (
        texts.join(few, texts["key"] == few["labelled"])
        .groupBy("labelled")
        .agg(F.min("t").alias("t"), F.min("label").alias("label"))
        .select("t", "label")
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda at: (marks[at], texts[at]))
        found = train([texts[at] for at in order], [marks[at] for at in order])
        fixed, weights = (found.landmarks.words, found.weights.tolist()) if found.landmarks else ([], [])
        yield pa.RecordBatch.from_pylist(
            [{"words": fixed, "weights": weights, "offset": found.offset, "slopes": found.slopes, "shifts": found.shifts}],
            schema=_MODEL,
        )

    row = sample.repartition(1).mapInArrow(
        learn, "words array<string>, weights array<double>, offset double, slopes array<double>, shifts array<double>"
    ).first()
    if row is None:
        return Machine(None, None, 0.0, [], [0.5])
    fixed = Landmarks(row.words) if row.words else None
    return Machine(fixed, np.array(row.weights), row.offset, row.slopes, row.shifts)


def classify(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every document."""
    machine = fit(docs, labels, key, text, label)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.concatenate([machine.scores(texts) for texts in text_slices(batch.column(1))])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["key", "score"])

        return work

    kind = docs.schema[key].dataType.simpleString()
    lean = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    return map_batches(lean, make, f"key {kind}, score double").select(
        F.col("key").alias(key),
        held_out("key", 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_clean(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents not predicted toxic, all columns kept; scored by their own text."""
    machine = fit(docs, labels, key, text, label)
    return docs.filter(score_column(machine.scores)(F.col(text).cast("string")) < threshold)

"""Hidden Markov language model over words, trained by Baum-Welch.

A word is emitted in two steps: a hidden state emits a word class, the class
emits the word. The most frequent words are classes of their own; all others
fall into classes by a hash of their last three bytes. The second step does not
depend on the state, so the probability of a text is that of its sequence of
classes, which the scaled forward recursion gives exactly, times one factor per
token, which only needs the word's count. That splits the work well:

* Words are counted over all training documents, in every task first. The table
  of counts is never sent anywhere whole. Its most frequent words, a bounded
  number, go to all tasks; tokens of other words, a tenth of the text, meet
  their counts in a shuffled join and come back as two sums per document.
* Documents are kept as class numbers in the shared folder. One Baum-Welch
  round is a pass over them; expected counts, a bounded table, are added in each
  task and then across tasks. Training sequences are pieces of at most
  ``PIECE`` tokens; likelihoods are always those of whole documents.

Inside a class, words have add-half estimates with one unseen word of its own,
as the unigram base has for all words; unseen words thus have probability too.

Defined cases: null counts as the empty text, whose one token is the end;
without training documents counts are zero and the base is 0 per token; equal
rows are scored each for itself and learned from each for itself; rows with a
null key are training rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsieve.llm.common import held_out, stage, text_bytes

STATES = 8
ROUNDS = 5
#: Words that tasks hold with their counts, and those that are own classes.
HOT_WORDS = 200_000
OWN_WORDS = 2048
SUFFIX_CLASSES = 1024
#: Longest training sequence, and sequences per step of the recursion.
PIECE = 256
_TOGETHER = 1024
#: Distinct words a task counts before it passes them on.
_COUNTED = 400_000
#: Weight of the corpus's class shares in the shares of a state.
_PRIOR = 50.0
_END = b""


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words and the end."""
    words = text.lower().split()
    words.append(_END)
    return words


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SUFFIX_CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """``word``, its suffix ``class`` and count ``n`` in the texts ``t``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(words, type=pa.binary()),
                    pa.array([suffix_class(word) for word in words], type=pa.int32()),
                    pa.array(list(counts.values()), type=pa.int64()),
                ],
                names=["word", "class", "n"],
            )

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                counts.update(words_of(text))
                if len(counts) > _COUNTED:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return (
        docs.select("t")
        .mapInArrow(count, "word binary, class int, n long")
        .groupBy("word", "class")
        .agg(F.sum("n").alias("n"))
    )


class Vocabulary:
    """What every task knows of the words: the hot ones and the classes."""

    def __init__(self, counts: DataFrame, hot_words: int = HOT_WORDS, own_words: int = OWN_WORDS):
        size = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.tokens, self.distinct = size.n or 0, size.v
        quarter = F.floor(F.log2("n") * 4).cast("int").alias("q")
        levels = counts.groupBy(quarter).agg(F.count(F.lit(1)).alias("v"), F.min("n").alias("n")).collect()
        least, held = None, 0
        for level in sorted(levels, key=lambda row: -row.q):
            held += level.v
            if held > hot_words:
                break
            least = level.n
        # At most ``hot_words`` rows, by the levels just counted.
        hot = counts.filter(F.col("n") >= least).collect() if least is not None else []
        hot.sort(key=lambda row: (-row.n, bytes(row.word)))
        self.index = {bytes(row.word): at for at, row in enumerate(hot)}
        self.counts = np.array([row.n for row in hot], dtype=np.int64)
        own = min(own_words, len(hot))
        self.own = own
        self.classes = np.array(
            [at if at < own else own + row["class"] for at, row in enumerate(hot)], dtype=np.int64
        )
        total, kinds = np.zeros(SUFFIX_CLASSES), np.zeros(SUFFIX_CLASSES)
        for row in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            total[row["class"]], kinds[row["class"]] = row.n, row.v
        for row in hot[:own]:
            total[row["class"]] -= row.n
            kinds[row["class"]] -= 1
        #: Denominators of the add-half estimates inside suffix classes.
        self.below = total + 0.5 * (kinds + 1)
        mass = np.concatenate([self.counts[:own], self.below])
        self.shares = mass / mass.sum()

    @property
    def base_below(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


class _Lookup(dict):
    """Places of hot words; for others minus one minus their suffix class."""

    def __missing__(self, word: bytes) -> int:
        return -1 - suffix_class(word)


_ENCODED = pa.schema(
    [
        ("row", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("known", pa.int64()),
        ("own_sum", pa.float64()),
        ("class_sum", pa.float64()),
        ("below_sum", pa.float64()),
        ("classes", pa.binary()),
        ("rest", pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))),
    ]
)


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Documents ``(key, held_out, t)`` as classes, sums over hot words, and the rest."""
    kind = docs.schema["key"].dataType.simpleString()
    own = vocabulary.own
    logs = np.log10(vocabulary.counts + 0.5)
    below = np.log10(vocabulary.below)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(vocabulary.index)
        row = TaskContext.get().partitionId() << 32
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                columns: dict[str, list] = {field.name: [] for field in _ENCODED}
                for text, out in zip(text_bytes(batch.column(2)), batch.column(1).to_pylist()):
                    words = words_of(text)
                    at = np.fromiter(map(lookup.__getitem__, words), dtype=np.int64, count=len(words))
                    hot = at >= 0
                    classes = np.where(hot, 0, own - 1 - at)
                    classes[hot] = vocabulary.classes[at[hot]]
                    alone = classes < own
                    rest = Counter(words[i] for i in np.flatnonzero(~hot).tolist())
                    values = (
                        row, out, len(words), int(hot.sum()),
                        float(logs[at[alone]].sum()), float(logs[at[hot & ~alone]].sum()),
                        float(below[classes[~alone] - own].sum()),
                        classes.astype("<u2").tobytes(),
                        [{"word": word, "times": times} for word, times in rest.items()],
                    )
                    for column, value in zip(columns.values(), values):
                        column.append(value)
                    row += 1
                arrays = [pa.array(columns[field.name], type=field.type) for field in _ENCODED]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *arrays], names=["key", *_ENCODED.names]
                )

    return docs.select("key", "held_out", "t").mapInArrow(
        encode,
        f"key {kind}, row long, held_out boolean, n_tokens long, known long, own_sum double, "
        "class_sum double, below_sum double, classes binary, rest array<struct<word: binary, times: int>>",
    )


class Model:
    """Start, transition and emission probabilities; rows of ``emit`` are classes."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, shares: np.ndarray, states: int = STATES) -> Model:
        """Shares of the corpus, disturbed for each state, and lasting states."""
        noise = np.random.default_rng(7).normal(0.0, 0.5, (len(shares), states))
        emit = shares[:, None] * np.exp(noise)
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def after(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Model:
        """The maximising model of expected counts, smoothed towards ``shares``."""
        emit = emit + _PRIOR * shares[:, None]
        move = move + 0.1
        start = start + 0.1
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural logarithms of the probabilities of whole sequences."""
        order = sorted(range(len(sequences)), key=lambda at: -len(sequences[at]))
        lengths = np.array([len(sequences[at]) for at in order], dtype=np.int64)
        flat = np.concatenate([sequences[at] for at in order]) if order else np.zeros(0, dtype=np.int64)
        begin = np.cumsum(lengths) - lengths
        out = np.zeros(len(order))
        alpha = np.tile(self.start, (len(order), 1))
        for step in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-lengths, -step, side="left"))
            alpha = alpha[:n] @ self.move if step else alpha[:n]
            alpha *= self.emit[flat[begin[:n] + step]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            out[:n] += np.log(scale)
        back = np.empty(len(order))
        back[order] = out
        return back

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions (forward-backward)."""
        states, classes = self.emit.shape[1], self.emit.shape[0]
        start, move = np.zeros(states), np.zeros((states, states))
        emit = np.zeros((states, classes))
        sequences = sorted(sequences, key=len, reverse=True)
        for at in range(0, len(sequences), _TOGETHER):
            group = sequences[at : at + _TOGETHER]
            lengths = np.array([len(one) for one in group])
            longest = int(lengths[0])
            table = np.zeros((longest, len(group)), dtype=np.int64)
            for place, one in enumerate(group):
                table[: len(one), place] = one
            active = [int(np.searchsorted(-lengths, -step, side="left")) for step in range(longest)]
            forward = np.zeros((longest, len(group), states))
            emits: list[np.ndarray] = []
            scales: list[np.ndarray] = []
            for step, n in enumerate(active):
                emitted = self.emit[table[step, :n]]
                alpha = (forward[step - 1, :n] @ self.move if step else self.start) * emitted
                scale = alpha.sum(axis=1, keepdims=True)
                forward[step, :n] = alpha / scale
                emits.append(emitted)
                scales.append(scale)
            beta = np.ones((len(group), states))
            for step in range(longest - 1, -1, -1):
                n = active[step]
                if step + 1 < longest:
                    m = active[step + 1]
                    ahead = emits[step + 1] * beta[:m] / scales[step + 1]
                    move += self.move * (forward[step, :m].T @ ahead)
                    beta[:m] = ahead @ self.move.T
                forward[step, :n] *= beta[:n]
            start += forward[0].sum(axis=0)
            used = np.arange(longest)[:, None] < lengths[None, :]
            seen, weights = table[used], forward[used]
            for state in range(states):
                emit[state] += np.bincount(seen, weights=weights[:, state], minlength=classes)
        return start, move, emit.T


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(value, dtype="<u2").astype(np.int64) for value in column.to_pylist()]


def baum_welch(texts: DataFrame, model: Model, shares: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Train on all rows of ``classes``; one pass and one small shuffle per round."""
    states = len(model.start)
    columns = [f"s{state}" for state in range(states)]
    schema = "kind int, place int, " + ", ".join(f"{name} double" for name in columns)
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((1, states)), np.zeros((states, states)), np.zeros_like(model.emit)]
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    pieces = [
                        one[cut : cut + PIECE]
                        for one in _sequences(whole.slice(at, 2000).column(0))
                        for cut in range(0, len(one), PIECE)
                    ]
                    for held, more in zip(total, model.expected(pieces)):
                        held += more
            for kind, held in enumerate(total):
                places = pa.array(np.arange(len(held), dtype=np.int32))
                kinds = pa.array(np.full(len(held), kind, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [kinds, places, *(pa.array(np.ascontiguousarray(c)) for c in held.T)],
                    names=["kind", "place", *columns],
                )

        summed = (
            texts.select("classes")
            .mapInArrow(expect, schema)
            .groupBy("kind", "place")
            .agg(*(F.sum(name).alias(name) for name in columns))
        )
        found = [np.zeros((1, states)), np.zeros((states, states)), np.zeros_like(model.emit)]
        for row in summed.collect():  # the size of the model
            found[row.kind][row.place] = row[2:]
        model = model.after(found[0][0], found[1], found[2], shares)
    return model


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", remainder: int = 1, states: int = STATES,
    rounds: int = ROUNDS, hot_words: int = HOT_WORDS, own_words: int = OWN_WORDS,
) -> DataFrame:
    """Unigram base and model score, log10, of every document."""
    source = docs.select(
        F.col(key).alias("key"),
        held_out(key, remainder).alias("held_out"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
    )
    counts = stage(word_counts(source.filter(~F.col("held_out"))), "word-counts")
    vocabulary = Vocabulary(counts, hot_words, own_words)
    kept = stage(encoded(source, vocabulary), "encoded")
    model = baum_welch(
        kept.filter(~F.col("held_out")), Model.first(vocabulary.shares, states), vocabulary.shares, rounds
    )

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.likelihoods(_sequences(batch.column(1))) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "states_log"])

    hidden = kept.select("row", "classes").mapInArrow(forward, "id long, states_log double")
    rest = kept.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    sums = (
        rest.join(counts.select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.5))).alias("rest_sum"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rest_known"),
        )
        .withColumnRenamed("row", "rest_row")
    )
    slim = kept.drop("classes", "rest")
    joined = slim.join(hidden, slim["row"] == hidden["id"]).join(
        sums, slim["row"] == sums["rest_row"], "left"
    )
    rest_sum = F.coalesce("rest_sum", F.lit(0.0))
    inside = F.col("class_sum") + rest_sum
    base = F.col("own_sum") + inside - F.col("n_tokens") * F.lit(math.log10(vocabulary.base_below))
    return joined.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(int(vocabulary.tokens)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("states_log") + inside - F.col("below_sum")).alias("score"),
    )

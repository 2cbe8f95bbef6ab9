"""Pack documents into fixed windows: combinations of lengths by least squares.

Each task collects the token counts of its documents in shards of bounded size.
Whole windows of a long document stand alone; the remainders form a histogram
of lengths. Shallow combinations that fill a window exactly are the columns of a
non-negative least squares problem against that histogram: all pairs, and of the
triples those with two equal lengths and those whose last two are halves of the
rest (all triples would be half a million columns for a window of 2,048); the rounded solution says how often each combination is laid. What
remains is packed greedily, largest first, and only where no piece fits is one
cut. The tail of a shard is cut into powers of two, which need no padding.

The histogram belongs to a shard, not to the corpus: tokens are made once,
nothing is shuffled, a lost task is simply run again, and no document waits for
a plan of all others. As pieces fill their windows the price is not padding but
at most eleven short sequences per shard.

Defined cases: null and empty texts are a single end id; equal rows are packed
each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsieve.llm.tokens import Encoder

WINDOW = 2048
END_ID = 1
#: Tokens that a task holds before it packs them; 16 MB of ids.
SHARD_TOKENS = 4_000_000
_TEXTS_AT_ONCE = 1_000_000

#: A piece of a document: document, first id, number of ids.
Piece = tuple[int, int, int]


def combinations(window: int) -> np.ndarray:
    """Rows of three lengths that fill ``window``; a third of 0 means a pair."""
    a = np.arange(1, window)
    b = np.maximum((window - a) // 2, 1)
    rows = np.concatenate(
        [
            np.stack([a, window - a, 0 * a], axis=1),
            np.stack([a, a, window - 2 * a], axis=1),
            np.stack([a, b, window - a - b], axis=1),
        ]
    )
    rows = rows[(rows[:, :2] > 0).all(axis=1) & (rows[:, 2] >= 0)]
    return np.unique(np.sort(rows, axis=1)[:, ::-1], axis=0)


def repeat_counts(histogram: np.ndarray, columns: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative least squares: how often each column should be laid.

    Accelerated projected gradient on ``|A x - histogram|``; ``A`` has the
    multiplicity of each length in each combination and is never stored.
    """
    used = columns.shape[1]
    weight = (columns > 0).astype(float)
    size = len(histogram)
    spread = np.bincount(columns.ravel(), weights=np.repeat(weight.sum(axis=1), used), minlength=size)
    step = 1.0 / max(1.0, used * spread[1:].max(initial=1.0))
    target = histogram.astype(float)
    target[0] = 0.0
    x = np.zeros(len(columns))
    y, t = x, 1.0
    for _ in range(rounds):
        laid = np.bincount(columns.ravel(), weights=np.repeat(y, used), minlength=size)
        laid[0] = 0.0
        slope = ((laid - target)[columns] * weight).sum(axis=1)
        after = np.maximum(y - step * slope, 0.0)
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


def _laid(by_length: dict[int, list[Piece]], window: int) -> Iterator[list[Piece]]:
    """Windows filled by rounded combinations; takes their pieces away."""
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, pieces in by_length.items():
        histogram[length] = len(pieces)
    columns = combinations(window)
    columns = columns[((histogram[columns] > 0) | (columns == 0)).all(axis=1)]
    if not len(columns):
        return
    wanted = np.rint(repeat_counts(histogram, columns)).astype(np.int64)
    for at in np.argsort(-wanted, kind="stable").tolist():
        parts = [part for part in columns[at].tolist() if part]
        for _ in range(int(wanted[at])):
            if any(len(by_length[part]) < parts.count(part) for part in parts):
                break
            yield [by_length[part].pop() for part in parts]


def _greedy(pieces: list[Piece], window: int) -> Iterator[list[Piece]]:
    """Largest first, then whatever fits best; one piece is cut if none fits."""
    pieces = sorted(pieces, key=lambda piece: piece[2])
    lengths = [piece[2] for piece in pieces]
    total = sum(lengths)
    while total >= window:
        filled, gap = [], window
        while gap:
            at = bisect_right(lengths, gap) - 1
            if at >= 0:
                filled.append(pieces.pop(at))
                gap -= lengths.pop(at)
            else:
                doc, start, length = pieces.pop(0)
                lengths.pop(0)
                filled.append((doc, start, gap))
                rest = (doc, start + gap, length - gap)
                at = bisect_left(lengths, rest[2])
                pieces.insert(at, rest)
                lengths.insert(at, rest[2])
                gap = 0
        total -= window
        yield filled
    stream = pieces[::-1]
    while total:
        gap = 1 << (total.bit_length() - 1)
        total -= gap
        filled = []
        while gap:
            doc, start, length = stream.pop()
            take = min(gap, length)
            filled.append((doc, start, take))
            if take < length:
                stream.append((doc, start + take, length - take))
            gap -= take
        yield filled


def pack_lengths(lengths: list[int], window: int = WINDOW) -> Iterator[list[Piece]]:
    """Sequences of pieces that cover documents of these lengths exactly once."""
    by_length: dict[int, list[Piece]] = {}
    for doc, length in enumerate(lengths):
        whole = length - length % window
        for start in range(0, whole, window):
            yield [(doc, start, window)]
        if length > whole:
            by_length.setdefault(length - whole, []).append((doc, whole, length - whole))
    yield from _laid(by_length, window)
    yield from _greedy([piece for pieces in by_length.values() for piece in pieces], window)


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    ranks: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece, with its ids, sequence and place in it.

    The tokenizer file, and the rank file of the same vocabulary, are read on the
    driver and sent with the tasks. Sequence ids are the task's number times 2^32
    plus a counter.
    """
    if tokenizer is None:
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
        ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    files = [Path(name).read_text(encoding="utf-8") if name else None for name in (tokenizer, ranks)]
    pattern = public_tokenizers.PATTERN
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, `offset` long" + (", ids binary" if with_ids else "")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*files, pattern)
        sequence = TaskContext.get().partitionId() << 32
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows: list[list] = [[] for _ in range(8)]
            for pieces in pack_lengths([len(one) for one in ids], window):
                offset = 0
                for doc, start, length in pieces:
                    part = ids[doc][start : start + length].tobytes()
                    values = (
                        keys[doc], start, length, zlib.crc32(part), len(ids[doc]),
                        sequence, offset, part,
                    )
                    for column, value in zip(rows, values):
                        column.append(value)
                    offset += length
                sequence += 1
                if len(rows[0]) >= 5_000:
                    yield batch_of(rows)
                    rows = [[] for _ in range(8)]
            if rows[0]:
                yield batch_of(rows)

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            arrays = [pa.array(rows[0], type=key_type)]
            arrays += [pa.array(column, type=pa.int64()) for column in rows[1:7]]
            if with_ids:
                arrays.append(pa.array(rows[7], type=pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            at = 0
            while at < batch.num_rows:
                texts, chars = [], 0
                while at + len(texts) < batch.num_rows and chars < _TEXTS_AT_ONCE:
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                keys += batch.column(0)[at : at + len(texts)].to_pylist()
                for one in encoder.encode(texts):
                    ids.append(np.append(one, np.uint32(end_id)))
                    held += len(ids[-1])
                at += len(texts)
                if held >= SHARD_TOKENS:
                    yield from packed()
                    keys, ids, held = [], [], 0
        if ids:
            yield from packed()

    lean = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    return lean.mapInArrow(run, schema).withColumnRenamed("key", key)

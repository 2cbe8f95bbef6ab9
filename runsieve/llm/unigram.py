"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces of a model file with their log scores are laid out in a double-array
trie over UTF-8 bytes. The best segmentation of a string is found by Viterbi;
a character that no piece starts with costs ten below the worst score and becomes
its bytes. Spaces become the marker, one marker is put in front, and decoding
undoes both and joins bytes back to characters.

In common vocabularies no piece has the marker after another character, so texts
can be cut before every run of spaces without changing the best path; likewise
around line breaks where no piece has one. Each distinct run is then encoded
once per task generation, many of them side by side: the Viterbi loop runs over
places in the run and depth in the trie, all runs of a length class at once. A
model without that property is encoded in whole texts.

Model files of the merging kind store merge ranks where unigram files store
logarithms; for those the score is the logarithm of a Zipf share of the rank.

Defined cases: null and empty texts have no pieces; a marker character in a text
decodes to a space; equal scores prefer the longer last piece; repeated rows are
encoded each for itself; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsieve.llm.common import text_slices

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
_LONG_RUN = 64
_CACHE_RUNS = 250_000
_TOGETHER = 20_000
_NORMAL, _BYTE = 1, 6


def double_array(pieces: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base``, ``check`` and ``value`` of a trie; the root is node 0.

    The child of node ``s`` by byte ``b`` is ``base[s] + b + 1`` where ``check``
    there is ``s``; ``value`` is a piece number or -1.
    """
    tree: dict = {}
    for text, number in pieces:
        node = tree
        for byte in text:
            node = node.setdefault(byte, {})
        node[-1] = number
    size = 1024
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    floor = 1
    todo = [(0, tree)]
    while todo:
        at, node = todo.pop()
        value[at] = node.get(-1, -1)
        children = sorted(byte for byte in node if byte >= 0)
        if not children:
            continue
        first, taken = children[0], 0
        slot = max(floor, first + 1)
        begun = slot
        while True:
            if slot + 258 >= len(base):
                more = len(base)
                base += [0] * more
                check += [-1] * more
                value += [-1] * more
            if check[slot] >= 0:
                taken += 1
            elif all(check[slot - first + byte] < 0 for byte in children):
                break
            slot += 1
        # Where nearly all slots are taken, later searches begin behind them.
        if taken >= 0.95 * (slot - begun + 1):
            floor = slot
        start = slot - first - 1
        base[at] = start
        for byte in children:
            check[start + byte + 1] = at
            todo.append((start + byte + 1, node[byte]))
    return tuple(np.array(part, dtype=np.int32) for part in (base, check, value))


class Vocabulary:
    """Trie, scores and bytes of a model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("only models with a marker in front and no other normalisation are read")
        normal = [(at, one) for at, one in enumerate(proto.pieces) if one.type == _NORMAL]
        merged = proto.trainer_spec.model_type == 2
        ranks = {at: rank for rank, (at, _) in enumerate(sorted(normal, key=lambda pair: -pair[1].score))}
        share = np.log(sum(1.0 / (rank + 1) for rank in range(len(normal))))
        self.scores = np.zeros(len(proto.pieces))
        for at, one in normal:
            self.scores[at] = -np.log(ranks[at] + 1) - share if merged else one.score
        self.unknown = min((self.scores[at] for at, _ in normal), default=0.0) - UNKNOWN_PENALTY
        self.base, self.check, self.value = double_array([(one.piece.encode(), at) for at, one in normal])
        self.longest = max((len(one.piece.encode()) for _, one in normal), default=0)
        self.byte_ids = np.zeros(256, dtype=np.int64)
        self.bytes_of: list[bytes] = []
        found = 0
        for at, one in enumerate(proto.pieces):
            if one.type == _BYTE:
                self.byte_ids[int(one.piece[1:-1], 16)] = at
                self.bytes_of.append(bytes([int(one.piece[1:-1], 16)]))
                found += 1
            else:
                self.bytes_of.append(one.piece.encode() if one.type == _NORMAL else b"")
        if found != 256:
            raise ValueError("the model has no byte fallback")
        self.is_byte = np.array([one.type == _BYTE for one in proto.pieces])
        texts = [one.piece for _, one in normal]
        self.by_runs = not any(MARKER in text.lstrip(MARKER) for text in texts)
        self.by_lines = self.by_runs and not any("\n" in text for text in texts)

    def paths(self, runs: list[bytes]) -> list[np.ndarray]:
        """Piece ids of the best path of each run."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(runs)
        by_size: dict[int, list[int]] = {}
        for at, run in enumerate(runs):
            if run:
                by_size.setdefault((len(run) + 3) // 4 if len(run) <= _LONG_RUN else -1 - at, []).append(at)
        for places in by_size.values():
            for cut in range(0, len(places), _TOGETHER):
                part = places[cut : cut + _TOGETHER]
                for at, ids in zip(part, self._viterbi([runs[place] for place in part])):
                    out[at] = ids
        return out

    def _viterbi(self, runs: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(run) for run in runs])
        wide = int(sizes.max())
        joined = np.frombuffer(b"".join(run.ljust(wide, b"\0") for run in runs), dtype=np.uint8)
        table = joined.reshape(len(runs), wide).astype(np.int64)
        starts = ((table & 0xC0) != 0x80) & (np.arange(wide)[None, :] < sizes[:, None])
        best = np.full((len(runs), wide + 1), -np.inf)
        best[:, 0] = 0.0
        came = np.zeros((len(runs), wide + 1), dtype=np.int64)
        by = np.full((len(runs), wide + 1), -1, dtype=np.int64)
        ends = np.where(table < 0xC0, 1, np.where(table < 0xE0, 2, np.where(table < 0xF0, 3, 4)))

        def reach(rows: np.ndarray, place: np.ndarray | int, end: np.ndarray | int, value, piece) -> None:
            better = value > best[rows, end]
            rows = rows[better]
            pick = lambda x: x[better] if isinstance(x, np.ndarray) else x
            best[rows, pick(end)] = value[better]
            came[rows, pick(end)] = pick(place)
            by[rows, pick(end)] = pick(piece)

        for place in range(wide):
            active = np.flatnonzero(starts[:, place])
            if not len(active):
                continue
            single = np.zeros(len(runs), dtype=bool)
            rows, node = active, np.zeros(len(active), dtype=np.int64)
            for depth in range(min(self.longest, wide - place)):
                end = place + depth + 1
                after = self.base[node] + table[rows, place + depth] + 1
                fits = (self.check[after] == node) & (end <= sizes[rows])
                rows, node = rows[fits], after[fits]
                if not len(rows):
                    break
                piece = self.value[node]
                has = piece >= 0
                if has.any():
                    own = rows[has]
                    reach(own, place, end, best[own, place] + self.scores[piece[has]], piece[has].astype(np.int64))
                    single[own[ends[own, place] == depth + 1]] = True
            alone = active[~single[active]]
            if len(alone):
                reach(alone, place, place + ends[alone, place], best[alone, place] + self.unknown, -1)
        return self._walked(table, sizes, came, by)

    def _walked(self, table: np.ndarray, sizes: np.ndarray, came: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
        """Ids along the best paths, from their ends; unknown characters as bytes."""
        n, wide = table.shape
        ids = np.zeros((n, wide), dtype=np.int64)
        left = np.full(n, wide, dtype=np.int64)
        rows, at = np.arange(n), sizes.copy()
        while len(rows):
            piece, start = by[rows, at], came[rows, at]
            known = piece >= 0
            left[rows[known]] -= 1
            ids[rows[known], left[rows[known]]] = piece[known]
            for back in range(1, 5):
                some = ~known & (at - back >= start)
                own = rows[some]
                left[own] -= 1
                ids[own, left[own]] = self.byte_ids[table[own, at[some] - back]]
            more = start > 0
            rows, at = rows[more], start[more]
        return [ids[row, begin:] for row, begin in enumerate(left.tolist())]


class Encoder:
    """Encodes and decodes texts, with a bounded cache of runs."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        pattern = r"\n[^ \n]*| +[^ \n]*|[^ \n]+" if vocabulary.by_lines else r" +[^ ]*|[^ ]+"
        self._runs = re.compile(pattern).findall if vocabulary.by_runs else lambda text: [text]
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _learn(self, runs: set[str]) -> None:
        if len(self._new) > _CACHE_RUNS:
            self._old, self._new = self._new, {}
        missing = []
        for run in runs:
            if run not in self._new:
                ids = self._old.get(run)
                if ids is None:
                    missing.append(run)
                else:
                    self._new[run] = ids
        found = self.vocabulary.paths([run.replace(" ", MARKER).encode() for run in missing])
        for run, ids in zip(missing, found):
            self._new[run] = ids.astype("<i4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self._runs(" " + text) if text else [] for text in texts]
        self._learn(set().union(*split))
        cache = self._new
        out = [np.frombuffer(b"".join(map(cache.__getitem__, runs)), dtype="<i4") for runs in split]
        for run in [run for run in set().union(*split) if len(run) > _LONG_RUN]:
            cache.pop(run, None)
        return out

    def decode(self, ids: np.ndarray) -> str:
        joined = b"".join(map(self.vocabulary.bytes_of.__getitem__, ids.tolist()))
        text = joined.decode("utf-8", errors="replace").replace(MARKER, " ")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """``key``, ``ids``, their number, how many are bytes, and whether they decode to the text."""
    content = Path(model or public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    vocabulary = Vocabulary(content)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(1)):
                found = encoder.encode(texts)
                sizes = np.array([len(ids) for ids in found])
                flat = np.concatenate(found)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                bytewise = np.concatenate(([0], np.cumsum(vocabulary.is_byte[flat])))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32))),
                        pa.array(sizes.astype(np.int64)),
                        pa.array((bytewise[offsets[1:]] - bytewise[offsets[:-1]]).astype(np.int64)),
                        pa.array([encoder.decode(ids) == one for ids, one in zip(found, texts)]),
                    ],
                    names=["key", "ids", "n_pieces", "n_bytes", "round_trip"],
                )
                at += len(texts)

    lean = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    schema = f"key {kind}, ids array<int>, n_pieces long, n_bytes long, round_trip boolean"
    return lean.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(rows: DataFrame, key: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """``key`` and ``text`` of encoded rows; null ids give the empty text."""
    content = Path(model or public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    vocabulary = Vocabulary(content)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = [encoder.decode(np.array(one or [], dtype=np.int64)) for one in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["key", "text"])

    lean = rows.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("i"))
    return lean.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)

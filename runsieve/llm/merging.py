"""Token counts by byte-pair merging on a heap and a linked list.

The symbols of a word are a linked list, and a heap holds its adjacent pairs that
the vocabulary can merge, by rank and then by place. The pair of lowest rank is
popped and merged, its two new neighbours are pushed, and pairs whose symbols
have changed since they were pushed are passed over. A word has as many tokens as
symbols at the start minus merges; no identifiers are emitted.

How a text becomes words (normal form, lower case, splitting, byte symbols) is
said by the tokenizer file and done by its library, so that every script comes
out as there. Such files drop white space between words, so a text is counted
run by run between white space, each distinct run once per task: both runs and
words are kept until too many are known. The strings of added tokens are cut out
of a run first and count one each.

One pass without a shuffle; a lost task is simply run again.

Defined cases: null and empty texts have no tokens; repeated rows are counted
each for itself; a run without white space is one run however long it is, and its
merging stays n log n; an empty table gives no rows; other columns are not read,
so their names cannot clash.
"""

from __future__ import annotations

import json
import os
import re
from heapq import heapify, heappop, heappush
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsieve.llm.common import map_batches, text_slices

LIMIT = 2048
#: Distinct runs, and distinct words, kept before a task forgets the older half.
CACHE_RUNS = 400_000
#: Longer runs and words are not kept.
CACHE_CHARS = 64
#: White space for Python that is not white space for tokenizer files.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")


class Kept:
    """A cache in two generations; what is still used moves to the new one."""

    def __init__(self, size: int):
        self.size = size
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def missing(self, keys) -> list[str]:
        """Bring the known keys to the new generation and return the others."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        out = []
        for key in keys:
            if key not in self.new:
                value = self.old.get(key)
                if value is None:
                    out.append(key)
                else:
                    self.new[key] = value
        return out


class Merges:
    """Which pairs of symbols a vocabulary merges, in which rank and to what."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        self.base = max(vocabulary.values(), default=0) + 1
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in merges]
        #: Rank of the pair ``left * base + right``, and the symbol that each rank makes.
        self.rank = {vocabulary[a] * self.base + vocabulary[b]: at for at, (a, b) in enumerate(pairs)}
        self.symbol = [vocabulary[a + b] for a, b in pairs]

    def made(self, symbols: list[int]) -> int:
        """How many merges a word of these symbols takes; ``symbols`` is used up."""
        rank_of, base, end = self.rank.get, self.base, len(symbols)
        # A pair is one number, its rank above its place.
        heap = []
        for at in range(end - 1):
            rank = rank_of(symbols[at] * base + symbols[at + 1])
            if rank is not None:
                heap.append(rank << 32 | at)
        heapify(heap)
        after = list(range(1, end + 1))
        before = list(range(-1, end - 1))
        merged = 0
        while heap:
            pair = heappop(heap)
            at = pair & 0xFFFFFFFF
            left, right = symbols[at], after[at]
            if left < 0 or right == end:
                continue
            rank = pair >> 32
            if rank_of(left * base + symbols[right]) != rank:
                continue
            merged += 1
            symbols[at] = symbol = self.symbol[rank]
            symbols[right] = -1
            behind = after[at] = after[right]
            if behind < end:
                before[behind] = at
                rank = rank_of(symbol * base + symbols[behind])
                if rank is not None:
                    heappush(heap, rank << 32 | at)
            place = before[at]
            if place >= 0:
                rank = rank_of(symbols[place] * base + symbol)
                if rank is not None:
                    heappush(heap, rank << 32 | place)
        return merged


class TokenCounter:
    """Counts the tokens of texts by the rules of a tokenizer file."""

    def __init__(self, rules: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(rules)
        self._normal, self._split = tokenizer.normalizer, tokenizer.pre_tokenizer
        content = json.loads(rules)
        model, added = content["model"], content.get("added_tokens") or []
        unusual = [k for k in ("unk_token", "dropout", "continuing_subword_prefix") if model.get(k)]
        unusual += [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or unusual:
            raise ValueError(f"not a plain byte-pair vocabulary: {unusual or model.get('type')}")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in added):
            raise ValueError("added tokens must be plain strings without white space")
        if [word for word, _ in self._words("a b\n")] != ["a", "b"]:
            raise ValueError("the tokenizer keeps white space")
        self._suffix = model.get("end_of_word_suffix") or ""
        self._symbols = vocabulary = model["vocab"]
        self._merges = Merges(vocabulary, model["merges"])
        # Whether a run of plain letters is one word, in lower case or as it is.
        letters = "".join(map(chr, (*range(65, 91), *range(97, 123))))
        whole = [word for word, _ in self._words(letters)]
        self._plain = {letters.lower(): str.lower, letters: str}.get(whole[0]) if len(whole) == 1 else None
        strings = sorted((t["content"] for t in added), key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, strings))) if strings else None
        self._runs, self._known = Kept(CACHE_RUNS), Kept(CACHE_RUNS)

    def _words(self, run: str) -> list[tuple[str, tuple[int, int]]]:
        text = self._normal.normalize_str(run) if self._normal else run
        return self._split.pre_tokenize_str(text)

    def _word_tokens(self, word: str) -> int:
        letters = [*word[:-1], word[-1] + self._suffix]
        symbols = [s for s in map(self._symbols.get, letters) if s is not None]
        return len(symbols) - self._merges.made(symbols.copy())

    def _run_tokens(self, run: str) -> int:
        if self._plain and run.isascii() and run.isalpha() and len(run) <= CACHE_CHARS:
            word = self._plain(run)
            if self._known.missing((word,)):
                self._known.new[word] = self._word_tokens(word)
            return self._known.new[word]
        total, parts = 0, [run]
        if self._added and self._added.search(run):
            parts = self._added.split(run)
            total = len(parts) - 1
        words = [word for part in parts if part for word, _ in self._words(part) if word]
        for word in self._known.missing(dict.fromkeys(words)):
            self._known.new[word] = self._word_tokens(word)
        known = self._known.new
        total += sum(map(known.__getitem__, words))
        for word in words:
            if len(word) > CACHE_CHARS:
                known.pop(word, None)
        return total

    def counts(self, texts: list[str]) -> list[int]:
        split = [_SPACE.split(t) if _SEPARATORS.search(t) else t.split() for t in texts]
        for run in self._runs.missing(set().union(*split)):
            self._runs.new[run] = self._run_tokens(run)
        known = self._runs.new
        out = [sum(map(known.__getitem__, runs)) for runs in split]
        for run in [run for run in set().union(*split) if len(run) > CACHE_CHARS]:
            known.pop(run, None)
        return out


def rules_of(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def count_tokens(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    tokenizer: str | None = None,
) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every document.

    ``tokenizer`` is the path of a tokenizer file on the driver.
    """
    rules = rules_of(tokenizer or public_tokenizers.path("word_bpe_49k.json"))

    def make():
        counter = TokenCounter(rules)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens = [n for texts in text_slices(batch.column(1)) for n in counter.counts(texts)]
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(tokens, pa.int64())], names=["key", "n_bytes", "n_tokens"]
            )

        return work

    kind = docs.schema[key].dataType.simpleString()
    lean = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    return map_batches(lean, make, f"key {kind}, n_bytes long, n_tokens long").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

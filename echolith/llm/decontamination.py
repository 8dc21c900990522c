"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The benchmark is a stated set of queries. It is taken in blocks of bounded size (``block_items`` items and ``block_words``
words), so what the workers hold never grows with the benchmark; each block's seeds join all documents, in one pass
and without a shuffle. Every n-gram of an item is a seed, in a document's words and in every ``width``-th of
them. A seed places the item, and the words around are aligned with it: matches score 2, mismatches and
gaps -1. A pair is reported when the best local score reaches ``threshold`` of what the whole item would
score, which holds for copies with about a third of their words edited. What cannot reach it, for too few
of its words are the item's, is not aligned.

With the defaults no pair is lost to the seeds. Score n of an item of n >= 5 words: where no two matches
are neighbours in both texts, an edit lies between each two, so m matches score m + 1 at most and m is
n - 1 or n; all edits between them but one or two are then single words put in, which leaves pairs two places apart.

A seed that many items hold, as those of a template do, meets each place of it in a document: the items are taken in ranges
then, split until the seeds that are placed at once are ``PLACED`` at most or of one item. An n-gram's code is a number in 63 bits; ``width``
and ``block_words`` for which it would not fit raise ``ValueError``.

Words are runs of letters and digits, lowered. Items of fewer than ``least_words`` words (nulls and empty
texts too) identify nothing and match nothing. Null texts match nothing; a null document or item id is
reported as null. Repeated documents and items are reported each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.llm.common import packed, rows, table

WORDS = re.compile(r"[^\W_]+")
MATCH, MISS, GAP = 2, -1, -1
#: Seeds of a document that are placed at once.
PLACED = 1 << 20


def word_list(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


@dataclass
class Block:
    """Items as word numbers, and the table from n-gram codes to the items that hold them."""

    ids: list
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    width: int
    codes: np.ndarray  # sorted, distinct
    starts: np.ndarray  # of each code's entries below
    owners: np.ndarray  # item of an entry
    offsets: np.ndarray  # place of the n-gram in it; entries of a code come by item

    def __post_init__(self) -> None:
        self.sizes = np.array([len(x) for x in self.items])
        self.begins, self.flat = np.cumsum(self.sizes) - self.sizes, np.concatenate(self.items)
        #: Of each entry its code, by number, and its item, as one number.
        self.keys = np.repeat(np.arange(len(self.codes)), np.diff(self.starts)) * len(self.items) + self.owners

    @classmethod
    def of(cls, found: list[tuple], width: int) -> Block:
        vocabulary: dict[str, int] = {}
        items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64) for _, words in found]
        if (len(vocabulary) + 1) ** width >= 1 << 63:
            raise ValueError(f"{width}-grams of {len(vocabulary)} words do not fit into a number: lower width or block_words")
        block = cls([i for i, _ in found], items, vocabulary, width, *(np.zeros(0, np.int64),) * 4)
        grams = [block.grams(x) for x in items]
        return block.with_entries(np.concatenate(grams), np.repeat(np.arange(len(items)), [len(g) for g in grams]), np.concatenate([np.arange(len(g)) for g in grams]))

    def grams(self, numbers: np.ndarray, step: int = 1) -> np.ndarray:
        """The code of the n-gram of every ``step``-th word at each place, -1 where a word is unknown."""
        n, size = len(numbers) - (self.width - 1) * step, len(self.vocabulary) + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(self.width):
            part = numbers[k * step : k * step + n]
            known &= part >= 0
            code = code * size + part
        return np.where(known, code, -1)

    def with_entries(self, codes: np.ndarray, owners: np.ndarray, offsets: np.ndarray) -> Block:
        order = np.lexsort((offsets, owners, codes))
        distinct, starts = np.unique(codes[order], return_index=True)
        return Block(self.ids, self.items, self.vocabulary, self.width, distinct, np.append(starts, len(codes)), owners[order], offsets[order])

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def found(self, numbers: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Places whose n-gram is in the table, and which one it is."""
        grams = self.grams(numbers, step)
        places = np.flatnonzero(grams >= 0)
        if not len(places) or not len(self.codes):
            return places[:0], places[:0]
        at = np.minimum(np.searchsorted(self.codes, grams[places]), len(self.codes) - 1)
        same = self.codes[at] == grams[places]
        return places[same], at[same]

    def shared(self, numbers: np.ndarray) -> np.ndarray:
        """How many words of each item occur in a text."""
        there = np.zeros(len(self.vocabulary) + 1, bool)
        there[numbers] = True  # -1 is the last
        return np.add.reduceat(there[self.flat], self.begins, dtype=np.int64)

    def placed(self, numbers: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, where it would begin) of every seed in a text, ordered, a range of items at a time; of items that may reach the threshold."""
        likely = self.shared(numbers) >= threshold * self.sizes
        if not likely.any():
            return
        places, which = (np.concatenate(x) for x in zip(*(self.found(numbers, step) for step in (1, 2)), strict=True))
        if not len(places):
            return
        keys, size = self.keys, len(self.items)
        ranges = [(0, size)]
        while ranges:
            low, high = ranges.pop()
            if not likely[low:high].any():
                continue
            if high - low == size:
                starts, stops = self.starts[which], self.starts[which + 1]
            else:
                starts, stops = np.searchsorted(keys, which * size + low), np.searchsorted(keys, which * size + high)
            sizes = stops - starts
            if high - low > 1 and sizes.sum() > PLACED:
                ranges += [((low + high) // 2, high), (low, (low + high) // 2)]
                continue
            entries = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            owners, firsts = self.owners[entries], np.repeat(places, sizes) - self.offsets[entries]
            owners, firsts = owners[likely[owners]], firsts[likely[owners]]
            if len(owners):
                order = np.lexsort((firsts, owners))
                yield owners[order], firsts[order]

    def within(self, numbers: np.ndarray, owners: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """How many words of an item occur in a stretch of a text, for each of several items and stretches."""
        known, size = np.flatnonzero(numbers >= 0), len(numbers) + 1
        keys, sizes = np.sort(numbers[known] * size + known), self.sizes[owners]
        begins = np.cumsum(sizes) - sizes
        words = self.flat[np.repeat(self.begins[owners] - begins, sizes) + np.arange(sizes.sum())] * size
        # The first occurrence from where the stretch begins must lie before its end.
        at = np.searchsorted(keys, words + np.repeat(lows, sizes))
        there = np.append(keys, np.iinfo(np.int64).max)[at] < words + np.repeat(highs, sizes)
        return np.add.reduceat(there, begins, dtype=np.int64)


def dense(item: np.ndarray, passage: np.ndarray, threshold: float) -> bool:
    """Whether words of the item lie as close in the passage as in an alignment that reaches the threshold."""
    length = int((3 - 2 * threshold) * len(item)) + 1
    own = np.zeros(max(int(item.max()), int(passage.max())) + 2, bool)
    own[item] = True  # the last place, of words that no item has, stays empty
    sums = np.concatenate(([0], np.cumsum(own[passage])))
    return (sums[length:] - sums[:-length]).max() >= threshold * len(item) if len(passage) > length else True


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local score, and the place in the passage where it ends (exclusive)."""
    steps = np.arange(len(passage) + 1) * -GAP
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, MATCH, MISS))
        row = np.maximum.accumulate(new + steps) - steps
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def hits(block: Block, text: str | None, threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, first word, end) of each item that the text contains, by its best passage."""
    numbers = block.numbers(word_list(text))
    for owners, firsts in block.placed(numbers, threshold):
        yield from aligned(block, numbers, owners, firsts, threshold)


def aligned(block: Block, numbers: np.ndarray, owners: np.ndarray, firsts: np.ndarray, threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """Those of the items ``owners``, which their seeds place at ``firsts``, that a text contains."""
    #: An alignment that reaches the threshold has no more words put in than this.
    slacks = (2 * (1 - threshold) * block.sizes).astype(np.int64) + 1
    cuts = np.flatnonzero((np.diff(owners) != 0) | (np.diff(firsts) > slacks[owners[1:]])) + 1
    starts, stops = np.append(0, cuts), np.append(cuts, len(owners))
    owners, slack = owners[starts], slacks[owners[starts]]
    lows, highs = np.maximum(firsts[starts] - slack, 0), np.minimum(firsts[stops - 1] + block.sizes[owners] + slack, len(numbers))
    likely = block.within(numbers, owners, lows, highs) >= threshold * block.sizes[owners]
    best: dict[int, tuple[float, int, int]] = {}
    for owner, low, high in zip(owners[likely].tolist(), lows[likely].tolist(), highs[likely].tolist(), strict=True):
        item = block.items[owner]
        if not dense(item, numbers[low:high], threshold):
            continue
        score, end = align(item, numbers[low:high])
        share = score / (MATCH * len(item))
        if share >= threshold and share > best.get(owner, (0.0, 0, 0))[0]:
            _, back = align(item[::-1], numbers[low : low + end][::-1])
            best[owner] = (share, low + end - back, low + end)
    for owner in sorted(best):
        yield (owner, *best[owner])


def blocks(items: DataFrame, id_col: str, text_col: str, width: int, least_words: int, block_items: int, block_words: int) -> Iterator[Block]:
    held: list[tuple] = []
    size = 0
    for i, text in items.select(id_col, text_col).toLocalIterator():
        if len(words := word_list(text)) < max(least_words, width):
            continue
        if held and (len(held) >= block_items or size + len(words) > block_words):
            yield Block.of(held, width)
            held, size = [], 0
        held.append((i, words))
        size += len(words)
    if held:
        yield Block.of(held, width)


def all_blocks(docs: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = 2, least_words: int = 5, block_items: int = 20_000, block_words: int = 1_000_000) -> list:
    """A broadcast of each block."""
    return [docs.sparkSession.sparkContext.broadcast(b) for b in blocks(items, item_col, text_col, width, least_words, block_items, block_words)]


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """``id_col, item_col, score, first_word, end_word, passage``: a row for each document and item that it contains."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type, item_type = base.schema["_id"].dataType, items.schema[item_col].dataType
    out_type = f"_id {id_type.simpleString()}, _item {item_type.simpleString()}, score double, first_word long, end_word long, passage string"
    found = docs.sparkSession.createDataFrame([], out_type)
    for shared in all_blocks(docs, items, item_col, text_col, **how):

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            def each() -> Iterator[tuple]:
                for i, text in rows(batches, "_id", "_text"):
                    for owner, score, start, end in hits(shared.value, text, threshold):
                        yield i, shared.value.ids[owner], score, start, end, " ".join(word_list(text)[start:end])

            yield from packed(each(), pa.schema([("_id", to_arrow_type(id_type)), ("_item", to_arrow_type(item_type)), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("passage", pa.string())]))

        found = found.union(base.mapInArrow(work, out_type))
    return found.withColumnsRenamed({"_id": id_col, "_item": item_col})


def is_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = 0.5, **how) -> Column:
    """A condition on ``docs``: its text contains no item."""
    clean = F.lit(True)
    for shared in all_blocks(docs, items, text_col=text_col, **how):
        judge = F.pandas_udf(lambda texts, shared=shared: texts.map(lambda t: next(hits(shared.value, t, threshold), None) is None), "boolean")
        clean = clean & judge(F.col(text_col))
    return clean


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

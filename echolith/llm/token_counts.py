"""Token counts of whole texts by heap-and-linked-list byte-pair merging.

A text is cut at the special strings of the tokenizer file (one token each, as its library does),
then into pretokens by the byte-level pattern. Each pretoken starts as one symbol a byte; a heap
yields the adjacent pair of lowest rank (leftmost first), the pair's symbols become one in a linked
list, and its new neighbours enter the heap. The count is the initial symbols minus the merges; no
identifier is ever looked up. A heap keeps a pretoken of n bytes at O(n log n), however long it is.

Nulls and empty texts count 0 bytes and 0 tokens; repeated rows are counted each; columns other than
the id and the text are ignored unless named in ``keep``.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.llm.common import packed, rows, table

#: The byte-level pretoken pattern (fixed value of the vocabulary's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges whose classes are the same in every Unicode version that libraries carry; a text with any
#: other character is cut by the tokenizer library itself, whose Unicode tables may be older or newer.
STABLE = r"[^\u0000-ԯ -⁤₠-₿←-⏺─-➿ぁ-ゖァ-ヺ一-龥가-힣]"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown, extra = [], 256
    for b in range(256):
        shown.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return shown


class PairCounts(dict):
    """Pretoken -> number of tokens, worked out when first asked for.

    ``most`` bounds the entries held, and so the memory of a Python worker; frequent pretokens come
    back at once after the cache is emptied.
    """

    def __init__(self, merges: list, most: int = 400_000, is_raw: bool = True):
        super().__init__()
        self.ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(merges)}
        self.most, self.is_raw, self.shown = most, is_raw, byte_symbols()

    def __missing__(self, pretoken: str) -> int:
        if len(self) >= self.most:
            self.clear()
        shown = self.shown
        found = self[pretoken] = self.count([shown[b] for b in pretoken.encode()] if self.is_raw else list(pretoken))
        return found

    def count(self, symbols: list[str]) -> int:
        n, rank = len(symbols), self.ranks.get
        heap = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        after, before, merged = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or rank((symbols[i], symbols[j])) != r:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            merged += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merged


class Counter:
    """Counts the tokens of texts by one tokenizer file; built once in each task."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.unstable, self.cut = regex.compile(STABLE), regex.compile(PATTERN)
        self.raw = PairCounts(spec["model"]["merges"])
        self.byte_level = PairCounts(spec["model"]["merges"], is_raw=False)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(map(self.part, parts))

    def part(self, text: str) -> int:
        if self.unstable.search(text):
            from tokenizers import pre_tokenizers

            cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
            return sum(self.byte_level[t] for t, _ in cut)
        return sum(map(self.raw.__getitem__, self.cut.findall(text)))


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row; one pass, no shuffle.

    ``tokenizer`` is the path of a byte-level BPE tokenizer file that every executor can open.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = base.schema["_id"].dataType
    with_length = base.select("_id", F.octet_length("_text").cast("long").alias("_bytes"), "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        count = Counter(tokenizer)
        schema = pa.schema([("_id", to_arrow_type(id_type)), ("_bytes", pa.int64()), ("_tokens", pa.int64())])
        yield from packed(((i, b, count(t)) for i, b, t in rows(batches, "_id", "_bytes", "_text")), schema)

    out = with_length.mapInArrow(work, f"_id {id_type.simpleString()}, _bytes long, _tokens long")
    return out.select(F.col("_id").alias(id_col), F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"), (F.col("_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

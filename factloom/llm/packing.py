"""Best-fit packing of tokenised documents into sequences of a fixed length.

Three steps. Tasks tokenise documents and cut the longer ones into pieces. The number of pieces of each length, at most
one count for each length up to the capacity however large the corpus is, goes to the driver, which plans the bins:
pieces above a third of the capacity are matched greedily, the longest with the longest that still fits, at most two to
a bin; shorter pieces, longest first, go where they leave the smallest gap. Equal pieces and equal bins are planned
together, as runs of consecutive bin numbers. Last, each piece gets its rank among those of its length (counted in
shards, never in one task) and reads its bin and place off the runs.

Defined results: a null text counts as empty; an empty text is the end id alone; texts of any length are tokenised
whole; repeated rows are packed as often as they occur; an empty table gives an empty result. Columns other than the key
and the text aren't read, so extra ones can't clash.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import Remembered, shards, stored, table, text_runs

CAPACITY, END_ID = 4096, 1
#: Words that a worker keeps with their ids.
WORDS = 150_000
#: Pieces of one length that are ranked in one task.
RANKED = 100_000

# The pattern by which the tokenizer splits a normal text, its classes of letters and numbers spelled out for
# the characters that PLAIN allows; all others are left to the tokenizer.
_LETTERS, _NUMBERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
PLAIN = re.compile("[ \n!-~\xa1-\xac\xae-įı-ſ]*")
SPECIAL = "<|"
# Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTED]
BYTE_CHARS = [chr(b) if b in _PRINTED else chr(256 + _OTHERS.index(b)) for b in range(256)]


class WordTokenizer:
    """Ids of texts by a word-end BPE tokenizer, as little-endian 32-bit bytes. No token spans the border of two words as
    the tokenizer's pattern splits them, so that the ids of a text are those of its words, which are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.words = Remembered(self.word, WORDS)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Of one word as the pattern splits it: the model's merges alone, over the characters that stand for its bytes."""
        if not word.isascii():
            word = "".join([BYTE_CHARS[b] for b in word.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.merge(word)])

    def ids(self, texts: list[str]) -> list[bytes]:
        get = self.words.__getitem__
        plain = ((t, PLAIN.fullmatch(t) and SPECIAL not in t) for t in texts)
        return [b"".join(map(get, PIECE.findall(t.lower()))) if p else self.odd(t) for t, p in plain]

    def odd(self, text: str) -> bytes:
        """A text with other characters: its runs between spaces and line ends, each by its words if it is plain."""
        get, out = self.words.__getitem__, []
        for run in re.split("[ \n]+", text):
            if PLAIN.fullmatch(run) and SPECIAL not in run:
                out += map(get, PIECE.findall(run.lower()))
            else:
                out.append(self.encode(run))
        return b"".join(out)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", *, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document, cut into pieces of at most `capacity` ids."""
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    kind = pa.list_(pa.struct(fields))
    end = np.array([end_id], "<u4").tobytes()

    def cut(raw: bytes) -> list[dict]:
        out = []
        for k, at in enumerate(range(0, len(raw), 4 * capacity)):
            part = raw[at : at + 4 * capacity]
            out.append({"piece": k, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)})
            if with_ids:
                out[-1]["ids"] = np.frombuffer(part, "<u4").astype("i4")
        return out

    @F.arrow_udf("array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint" + ",ids:array<int>" * with_ids + ">>")
    def pieces(texts: pa.Array) -> pa.Array:
        tok, out = tokenizer_of(path), []
        for plain in text_runs(texts):
            out += [cut(raw + end) for raw in tok.ids(plain)]
        return pa.array(out, kind)

    return df.select(F.col(key), F.inline(pieces(F.col(text))))


def plan_bins(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first bin, offset), and the number of bins. The pieces of a length whose ranks
    lie in a run go to consecutive bins, at the run's offset."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    rank: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first bin, bins)
    open_gaps: list[int] = []  # gaps that have bins, ascending
    bins = 0

    def put(n: int, count: int, first: int, offset: int) -> None:
        runs.append((n, rank[n], count, first, offset))
        rank[n] += count
        left[n] -= count

    def open_at(gap: int, first: int, count: int) -> None:
        if gap and count:
            if not gaps[gap]:
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            at = bisect.bisect_right(large, min(n, capacity - n)) - 1
            while at >= 0 and (not left[large[at]] or (large[at] == n and left[n] < 2)):
                at -= 1
            if at < 0:
                count = left[n]
                put(n, count, bins, 0)
                open_at(capacity - n, bins, count)
            else:
                mate = large[at]
                count = left[n] // 2 if mate == n else min(left[n], left[mate])
                put(n, count, bins, 0)
                put(mate, count, bins, n)
                open_at(capacity - n - mate, bins, count)
            bins += count

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(open_gaps, n)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
            else:
                gap, first, count = capacity, bins, -(-left[n] // (capacity // n))
                bins += count
            each = gap // n  # the fuller a bin gets, the better it fits: it takes all that it can
            whole = min(count, left[n] // each)
            for i in range(each if whole else 0):
                put(n, whole, first, capacity - gap + i * n)
            open_at(gap - each * n, first, whole)
            rest = min(each, left[n]) if whole < count else 0
            for i in range(rest):
                put(n, 1, first + whole, capacity - gap + i * n)
            if whole < count:
                open_at(gap - rest * n, first + whole, 1)
                open_at(gap, first + whole + 1, count - whole - 1)
    return runs, bins


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """pieces (key, piece, start, length, ids_crc32) with sequence_id and offset. Reads them three times: pass a table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = plan_bins(counts, capacity)
    runs.sort()
    laid = np.array(runs, "i8").reshape(-1, 5)
    shared = spark.sparkContext.broadcast((laid[:, 0] << 44 | laid[:, 1], laid[:, 1], laid[:, 3], laid[:, 4]))
    parts = shards(sum(counts.values()), RANKED, 8)
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(parts)).cast("int"))
    before = dealt.groupBy("length", "_shard").count().withColumn(
        "_before", F.sum("count").over(Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    )
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_shard").orderBy(key, "start", "ids_crc32")))
    ranked = ranked.join(before.drop("count"), ["length", "_shard"]).withColumn("_rank", F.col("_rank") - 1 + F.coalesce("_before", F.lit(0)))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        keys, first_rank, first_bin, offset = shared.value
        n, r = length.to_numpy(zero_copy_only=False).astype("i8"), rank.to_numpy(zero_copy_only=False).astype("i8")
        at = np.searchsorted(keys, n << 44 | r, "right") - 1
        return pa.StructArray.from_arrays([pa.array(first_bin[at] + r - first_rank[at]), pa.array(offset[at])], ["sequence_id", "offset"])

    return ranked.withColumn("_place", place("length", "_rank")).select(
        *(c for c in pieces.columns), F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset")
    )


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", *, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece of every document, in its place."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    pieces = stored(token_pieces(docs, key, text, path=path, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces")
    return pack(pieces, key, capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

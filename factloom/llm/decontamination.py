"""Benchmark decontamination: an FM-index over each shard of the training texts, searched for the benchmark's phrases.

A shard is the run of documents that a task holds at once. Its words are symbols: those of the phrases have numbers, a
run of other words, like the border between documents, ends a stretch, and a stretch that is shorter than the shortest
phrase is left out, as no phrase can lie in it. Each stretch ends in a terminator of its own, so that suffixes are
told apart within their stretch and copies of whole documents don't lengthen the sort. The index is the Burrows-Wheeler
transform of the stretches in a wavelet matrix, and the text positions of every 16th symbol and of every stretch's
first one. All phrases are searched backwards together; each occurrence is traced to a kept position; the occurrences
of a document are merged into spans.

The phrases are the distinct windows of the benchmark's items. Driver and tasks hold one block of a fixed number of
them at a time: each block has a pass over the documents of its own, whose hits are stored before the next one begins.

Defined results: null and empty texts have no words and no hits; texts of any length are one shard at least; repeated
documents each get their own result; repeated items count once each by their id; an item without words matches nothing;
items with a null id are ignored; an empty benchmark or corpus leaves nothing hit. Other columns of the documents are
kept; columns of the output's names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, shards, table, text_runs, words_of

#: Words of a window, phrases that one pass searches for, and text positions between two kept ones.
WINDOW, BLOCK, SAMPLED = 10, 50_000, 16
SHARD_CHARS = 4_000_000
WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
FOUND = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"


class WaveletMatrix:
    """rank(c, i): how often each symbol c is among the first i ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            ones = (symbols >> b & 1).astype(bool)
            before = np.zeros(len(ones) + 1, "i4")
            np.cumsum(ones, out=before[1:])
            zeros = len(ones) - int(before[-1])
            self.levels.append((before, zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(i), i
        for b, (before, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = (c >> b & 1).astype(bool)
            s, e = before[start], before[end]
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start


class FMIndex:
    """Over symbols above 0; runs of 0 end a stretch. Stretches shorter than `least` are left out."""

    def __init__(self, symbols: np.ndarray, least: int, bits: int, sampled: int = SAMPLED):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (symbols > 0).astype("i1"), [0]])))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= least
        starts, lengths = starts[long], (ends - starts)[long]
        self.stretches, self.size = len(starts), int(lengths.sum() + len(starts))
        if not self.stretches:
            return
        first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])  # of each stretch in the index's text
        owner = np.repeat(np.arange(len(starts)), lengths + 1)
        at = np.arange(self.size) - first[owner]  # place in the stretch
        last = at == lengths[owner]
        self.position = starts[owner] + at  # of each symbol in the shard
        text = np.where(last, 0, symbols[np.minimum(self.position, len(symbols) - 1)]).astype("i8")
        order = np.where(last, owner, self.stretches + text)
        step = 1
        while True:  # suffix sort by doubling; terminators are all different, so that it ends at the longest stretch
            key = order * (int(order.max()) + 2)
            key[:-step] += order[step:] + 1
            suffixes = np.argsort(key, kind="stable")
            new = np.zeros(self.size, bool)
            np.not_equal(key[suffixes][1:], key[suffixes][:-1], out=new[1:])
            order = np.empty(self.size, "i8")
            order[suffixes] = np.cumsum(new)
            if order[suffixes[-1]] == self.size - 1:
                break
            step *= 2
        self.bwt = np.where(at[suffixes] == 0, 0, text[suffixes - 1])
        self.less = self.stretches + np.concatenate([[0, 0], np.cumsum(np.bincount(text, minlength=(1 << bits) + 1)[1:])])
        self.matrix = WaveletMatrix(self.bwt, bits)
        self.kept = (at[suffixes] == 0) | (at[suffixes] % sampled == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(self.kept)])
        self.sample = self.position[suffixes[self.kept]]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; phrases are rows of equal length."""
        low, high = np.zeros(len(phrases), "i8"), np.full(len(phrases), self.size, "i8")
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            a = self.less[c] + self.matrix.rank(c, low[live])
            b = self.less[c] + self.matrix.rank(c, high[live])
            low[live], high[live] = a, b
            live = live[a < b]
            if not len(live):
                break
        found = np.zeros(len(phrases), bool)
        found[live] = True
        return low, np.where(found, high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the shard of the suffixes of these rows: steps back through the text to a kept position."""
        out, back, todo, rows = np.empty(len(rows), "i8"), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            kept = self.kept[rows]
            out[todo[kept]] = self.sample[self.kept_before[rows[kept]]] + back
            todo, rows = todo[~kept], rows[~kept]
            c = self.bwt[rows]
            rows, back = self.less[c] + self.matrix.rank(c, rows), back + 1
        return out


class Phrases:
    """Distinct windows of items, with the items of each, as numbered words grouped by length."""

    def __init__(self, windows: Iterable[tuple[tuple[bytes, ...], list[str]]]):
        self.words: dict[bytes, int] = {}
        by_length: dict[int, tuple[list, list]] = {}
        for words, items in windows:
            rows, owners = by_length.setdefault(len(words), ([], []))
            rows.append([self.words.setdefault(w, len(self.words) + 1) for w in words])
            owners.append(items)
        self.groups = [(np.array(rows, "i8"), owners) for _, (rows, owners) in sorted(by_length.items())]
        self.least = min(by_length, default=0)
        self.bits = max(1, len(self.words).bit_length())

    def hits(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """(words, merged spans of words, items) of each text; the texts are one shard."""
        sizes, symbols, get = [], [], self.words.get
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            symbols += [get(w, 0) for w in words]
            symbols.append(0)
        first = np.concatenate([[0], np.cumsum(np.array(sizes, "i8") + 1)])
        index = FMIndex(np.array(symbols, "i8"), self.least, self.bits) if self.groups else None
        starts, ends, items = [np.empty(0, "i8")], [np.empty(0, "i8")], {}
        for rows, owners in self.groups if index is not None and index.stretches else ():
            low, high = index.search(rows)
            counts = high - low
            phrase = np.repeat(np.arange(len(rows)), counts)
            place = index.locate(np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()))
            starts.append(place)
            ends.append(place + rows.shape[1])
            document = np.searchsorted(first, place, "right") - 1
            for d, p in np.unique(np.stack([document, phrase], 1), axis=0).tolist():
                items.setdefault(d, set()).update(owners[p])
        start, end = np.concatenate(starts), np.concatenate(ends)
        depth = np.bincount(start, minlength=first[-1] + 1) - np.bincount(end, minlength=first[-1] + 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(depth) > 0).astype("i1"), [0]])))
        spans: dict[int, list] = {}
        for s, e, d in zip(edge[::2].tolist(), edge[1::2].tolist(), (np.searchsorted(first, edge[::2], "right") - 1).tolist(), strict=True):
            spans.setdefault(d, []).append((s - int(first[d]), e - int(first[d])))
        for d, n in enumerate(sizes):
            yield n, spans.get(d, []), sorted(items.get(d, ()))


def windows_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase, items): the distinct windows of the items' words, space-joined, with the ids of the items that hold them."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            words = words_of(t.as_py() or "")
            out.append(list({b" ".join(words[i : i + window]).decode() for i in range(max(1, len(words) - window + 1))}) if words else [])
        return pa.array(out, pa.list_(pa.string()))

    cut = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.explode(split(F.col(text))).alias("phrase"))
    return cut.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


def finder(shared):
    """A function over Arrow batches that finds the phrases of a broadcast in texts."""

    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = []
            for plain in text_runs(batch, SHARD_CHARS):
                rows += shared.value.hits(plain)
            spans = pa.array(([{"start": s, "end": e} for s, e in r[1]] for r in rows), span)
            yield pa.StructArray.from_arrays([pa.array((r[0] for r in rows), pa.int64()), spans, pa.array((r[2] for r in rows), pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return find


def broadcast_phrases(spark: SparkSession, windows: DataFrame):
    """The phrases of at most a block's windows, in the memory of the driver and of each worker."""
    read = [(tuple(p.encode().split(b" ")), i) for p, i in windows.select("phrase", "items").toLocalIterator()]
    return spark.sparkContext.broadcast(Phrases(sorted(read)))


def find_phrases(docs: DataFrame, windows: DataFrame, text: str = "text", out: str = "found", block: int = BLOCK) -> DataFrame:
    """docs with a column (n_words, spans of words, items). windows: (phrase, items), see windows_of."""
    spark = docs.sparkSession
    blocks = shards(windows.count(), block)
    if blocks == 1:
        return docs.withColumn(out, finder(broadcast_phrases(spark, windows))(F.col(text)))
    scratch, number = Scratch(spark, "phrases"), "_number"
    while number in docs.columns:
        number += "_"
    rows = scratch.stored(docs.withColumn(number, F.monotonically_increasing_id()))
    held = windows.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)))
    hits, counts = [], None
    for k in range(blocks):  # one pass after the other; a block's phrases leave the executors after theirs
        shared = broadcast_phrases(spark, held.where(F.col("block") == k))
        found = rows.select(number, finder(shared)(F.col(text)).alias("f")).select(number, "f.*")
        found = scratch.stored(found if k == 0 else found.where(F.size("spans") > 0))
        counts = found.select(number, "n_words") if k == 0 else counts
        hits.append(found.where(F.size("spans") > 0).select(number, "spans", "items"))
        shared.destroy()

    def merge(done, s):
        top = F.try_element_at(done, F.lit(-1))
        wider = F.struct(top["start"].alias("start"), F.greatest(top["end"], s["end"]).alias("end"))
        return F.when(s["start"] <= top["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    none = F.array().cast("array<struct<start:int,end:int>>")
    together = reduce(DataFrame.union, hits).groupBy(number).agg(  # at most a row for each block
        F.aggregate(F.array_sort(F.flatten(F.collect_list("spans"))), none, merge).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = counts.join(together, number, "left").select(
        number, F.struct("n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).alias(out)
    )
    return rows.drop(out).join(merged, number).drop(number)


def without_spans(text: str, spans: list) -> str:
    """text without the words of these spans, and what stands between them; a line end takes their place."""
    words, parts, at = [m.span() for m in WORD.finditer(text)], [], 0
    for s, e in spans:
        parts.append(text[at : words[s][0]].rstrip())
        at = words[e - 1][1]
    return "\n".join(p for p in [*parts, text[at:].lstrip()] if p)


def remove_phrases(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """docs without the spans that hold phrases; documents that have no words left go."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array((without_spans(t, [(s["start"], s["end"]) for s in x]) if x else t for t, x in pairs), pa.string())

    out = "_found"
    while out in docs.columns:
        out += "_"
    found = find_phrases(docs, windows, text, out)
    lost = F.aggregate(f"{out}.spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    kept = found.where((lost == 0) | (lost < F.col(f"{out}.n_words")))
    return kept.withColumn(text, cut(F.col(text), F.col(f"{out}.spans"))).drop(out)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = windows_of(table(spark, sf_dir, "benchmark"))
    found = find_phrases(table(spark, sf_dir, "documents").select("doc_id", "text"), windows)
    hit = F.aggregate("found.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )

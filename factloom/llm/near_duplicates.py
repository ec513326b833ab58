"""Near duplicates: ProbMinHash sketches of word shingles, banding, and exact verification.

A shingle is five consecutive words, a shorter text is one shingle; all have the weight 1 here, as the similarity that
is verified is that of sets. Each shingle is a Poisson process of its weight's rate, whose arrivals fall on the sketch's
registers at random; a register keeps the shingle that arrives first. Two sketches agree in a register with the
probability Jaccard of the weighted shingles, with equal weights the Jaccard of their sets. A shingle stops as soon as
its next arrival is later than the latest register of its text, so that a long text costs about one arrival for each
shingle, whatever the number of registers.

Bands of five registers are bucket keys. Equal texts are one node. Every pair of nodes that share a bucket is verified,
or already in one class, or told apart by the triangle inequality; no estimate drops a pair:

* In each bucket, all nodes are compared with its first node, the pivot. Links make classes. Buckets with the same nodes
  count once.
* What isn't linked to the pivot is left. If that is more than a tile of nodes, it goes on as a bucket with a pivot of its
  own, for a few rounds. Jaccard distance is a metric: a node below 2 * 0.8 - 1 = 0.6 of the pivot can't reach 0.8 with any node that is linked to it. Nodes
  between 0.6 and 0.8 are compared with those that are linked, unless their classes are one.
* What is left after these rounds, many texts that share a passage but are not alike, is dealt into pairs of tiles of a
  bounded number of nodes, and each pair of tiles counts all common shingles by block products.

So a crowd of copies costs a row for each node and round; only a crowd of texts that are all unlike one another costs
tiles, the square of their number over TILE. Contents are sets of 64-bit shingle hashes, made once for each node that
meets another, in a table bucketed by node: a round moves the pairs to them, and the sets of the pairs' nodes once. Verification is exact: Jaccard of the sets, 0.8 or more. With 28 bands a pair at 0.8 shares no
bucket in 1 of 70,000 cases, at 0.85 in 1 of 10 million.

Defined results: a row with a null text is a class of its own; equal texts, empty ones too, are one class; texts without
words are near-duplicates of equal texts only; texts of any length are sketched whole; repeated rows belong to one
class; classes are connected components, named by their smallest id (null if all are null); an empty table gives an empty
result. Other columns aren't read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Remembered, Scratch, fresh, mix64, shards, table, text_runs, words_of

SIZE, BANDS, ROWS, SIMILARITY = 5, 28, 5, 0.8
#: Rounds with a pivot, nodes on one side of a tile, rows of a task of tiles, pairs in one place with one pivot, and nodes
#: in one bucket of the table of contents.
PIVOTS, TILE, DEALT, FAN, BUCKETED = 3, 1024, 2048, 2000, 4000
#: Entries of one block of an incidence matrix.
BLOCK = 1 << 20
_HASHES = Remembered(xxhash.xxh3_64_intdigest)


def shingle_stream(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of every shingle in order, repeats too."""
    parts, lengths = [], np.zeros(len(texts), "i8")
    for i, text in enumerate(texts):
        words = words_of(text)
        hashes = np.fromiter(map(_HASHES.__getitem__, words), "u8", len(words))
        if 0 < len(hashes) < size:  # one shingle, padded
            hashes = np.concatenate([hashes, np.full(size - len(hashes), 1, "u8")])
        lengths[i] = len(hashes)
        parts.append(hashes)
    words = np.concatenate(parts) if parts else np.empty(0, "u8")
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, "i8"), np.empty(0, "u8")
    hashed = np.zeros(count, "u8")
    for k in range(size):
        hashed = mix64(hashed * np.uint64(3) + words[k : k + count] + np.uint64(k))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)[:count]
    inside = np.arange(count) + size <= ends[owner]
    return owner[inside], hashed[inside]


def shingles(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), sorted: the distinct shingles of every text."""
    owner, hashed = shingle_stream(texts, size)
    if not len(hashed):
        return owner, hashed, np.empty(0, "i8")
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    new = np.flatnonzero(np.concatenate([[True], (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])]))
    return owner[new], hashed[new], np.diff(np.append(new, len(hashed)))


def sketches(texts: list[str], registers: int, size: int = SIZE, weighted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(registers of each text, whether the text has words): which shingle arrives first in each register. A shingle's
    weight is 1 + ln(count), or 1; with equal weights repeats arrive together and need not be counted."""
    if weighted:
        owner, hashed, counts = shingles(texts, size)
        rate = 1 + np.log(counts)
    else:
        owner, hashed = shingle_stream(texts, size)
        rate = None
    first = np.full(len(texts) * registers, np.inf)
    who = np.zeros(len(texts) * registers, "u8")
    latest, time, live = np.full(len(texts), np.inf), np.zeros(len(hashed)), np.arange(len(hashed))
    arrival = 0
    while len(live):
        drawn = mix64(hashed[live] + np.uint64(arrival * 0x9E3779B97F4A7C15 % 2**64))
        wait = -np.log(((drawn >> np.uint64(11)).astype("f8") + 0.5) / 2**53)
        time[live] += wait if rate is None else wait / rate[live]
        early = time[live] < latest[owner[live]]
        live, drawn = live[early], drawn[early]
        at = owner[live] * registers + (mix64(drawn + np.uint64(0x51ED27)) % np.uint64(registers)).astype("i8")
        when = time[live]
        np.minimum.at(first, at, when)
        wins = first[at] == when
        who[at[wins]] = hashed[live[wins]]
        latest = first.reshape(len(texts), registers).max(1)
        live = live[when < latest[owner[live]]]
        arrival += 1
    worded = np.zeros(len(texts), bool)
    worded[owner] = True
    return who.reshape(len(texts), registers), worded


def bucket_keys(who: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(who), bands), "u8") + np.arange(bands, dtype="u8")
    for k in range(rows):
        keys = mix64(keys * np.uint64(3) + who.reshape(len(who), bands, rows)[:, :, k])
    return keys.view("i8")


def with_sketch(docs: DataFrame, text: str, bands: int, rows: int, size: int) -> DataFrame:
    """docs with keys (buckets; none for a text without words)."""

    @F.arrow_udf("array<bigint>")
    def sketch(texts: pa.Array) -> pa.Array:
        keys, sizes = [np.empty(0, "i8")], []
        for plain in text_runs(texts):
            who, worded = sketches(plain, bands * rows, size, weighted=False)
            keys.append(bucket_keys(who, bands, rows)[worded].ravel())
            sizes.append(worded * bands)
        ends = np.cumsum(np.concatenate([[0], *sizes]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))

    return docs.withColumn("keys", sketch(F.col(text)))


def hashes_of(size: int):
    """A function from texts to their sets of shingle hashes, as sorted arrays."""

    @F.arrow_udf("array<bigint>")
    def hashes(texts: pa.Array) -> pa.Array:
        sets, ends = [np.empty(0, "i8")], [np.zeros(1, "i8")]
        for plain in text_runs(texts):
            owner, hashed, _ = shingles(plain, size)
            sets.append(hashed.view("i8"))
            ends.append(ends[-1][-1] + np.cumsum(np.bincount(owner, minlength=len(plain))))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(sets)))

    return hashes


def joining_links(sets: list[np.ndarray], labels: list, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets with this similarity that join different labels, as few as connect what is connected. side: 0 or 1;
    with both, only pairs across are wanted, else all."""
    totals = np.array([len(s) for s in sets], "i8")
    uniq, column, counts = np.unique(np.concatenate([np.empty(0, "i8"), *sets]), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = np.repeat(np.arange(len(sets)), totals)[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rows, cols = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() and not side.all() else (np.arange(len(sets)),) * 2
    place = np.zeros((2, len(sets)), "i8")  # of each set among the rows and among the columns, from 1; 0 for none
    place[0, rows], place[1, cols] = np.arange(1, len(rows) + 1), np.arange(1, len(cols) + 1)
    common = np.zeros((len(rows), len(cols)), "f4")
    width = max(16, BLOCK // max(1, len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        held = []
        for k, n in ((0, len(rows)), (1, len(cols))):
            part = np.zeros((n + 1, width), "f4")
            part[place[k, owner[a:b]], column[a:b] - at] = 1
            held.append(part[1:])
        common += held[0] @ held[1].T
    enough = common >= (similarity - 1e-9) * np.maximum(totals[rows][:, None] + totals[cols][None, :] - common, 1)
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i in range(len(rows)):
        for j in np.flatnonzero(enough[i]).tolist():
            p, q = int(rows[i]), int(cols[j])
            a, b = root(labels[p]), root(labels[q])
            if p != q and a != b:
                parent[a] = b
                links.append((p, q))
    return links


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node of each connected component of (a, b), by taking over the smallest label among
    the neighbours and then the label's own label, until nothing changes."""
    both = scratch.stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = scratch.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        taken = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = taken.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        new = scratch.stored(jumped.select("node", "old", F.coalesce("next", "label").alias("label")))
        moved = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def similarities(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """(node, pivot, sim) of the pairs (node, pivot), by the sets of contents (node, hashes). A pivot with more than FAN
    pairs stands in several places."""
    hot = pairs.groupBy("pivot").count().where(F.col("count") > FAN)
    hot = hot.select("pivot", F.ceil(F.col("count") / FAN).cast("int").alias("fan"))
    placed = pairs.join(hot, "pivot", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("fan", F.lit(1))).cast("int")).drop("fan")
    pivots = pairs.groupBy("pivot").count().withColumn("part", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("count") / FAN) - 1).cast("int"))))
    pivots = pivots.join(contents.select(F.col("node").alias("pivot"), F.col("hashes").alias("pivot_hashes")), "pivot").drop("count")
    met = placed.join(contents, "node").join(pivots, ["pivot", "part"])
    common = met.select("node", "pivot", F.size("hashes").alias("n"), F.size("pivot_hashes").alias("m"), F.size(F.array_intersect("hashes", "pivot_hashes")).alias("both"))
    return common.select("node", "pivot", (F.col("both") / F.greatest(F.lit(1), F.col("n") + F.col("m") - F.col("both"))).alias("sim"))


def crowds(members: DataFrame, where: str = "n > 1") -> DataFrame:
    """(bucket, pivot, n) of the buckets of members (bucket, node, label): of buckets with the same nodes one alone."""
    sums = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("node").alias("pivot"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("x"),
    )
    return sums.where(where).groupBy("n", "h", "x", "pivot").agg(F.min("bucket").alias("bucket")).select("bucket", "pivot", "n")


def tiles_between(between: DataFrame, members: DataFrame, linked: DataFrame, number: int) -> DataFrame:
    """Tiles of between (bucket, pivot, pivot_label, node, label), on side 0, and the nodes of their buckets that are linked
    to the pivot, on side 1."""
    tasks = between.groupBy("bucket", "pivot", "pivot_label").agg(F.ceil(F.count("*") / TILE).cast("int").alias("t"))
    joined = members.join(tasks, ["bucket", "pivot"]).join(linked, ["node", "pivot"])
    sizes = joined.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("u"))

    def side(part: DataFrame, own: str, own_tile: str, other: str, other_tile: str, which: int, label: str) -> DataFrame:
        named = part.withColumn(own_tile, F.pmod(F.xxhash64("node"), own).cast("int")).withColumn(other_tile, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return named.select("bucket", F.lit(number).alias("round"), "i", "j", F.lit(which).alias("side"), "node", F.col(label).alias("label"))

    first = between.join(tasks.select("bucket", "t"), "bucket").join(sizes, "bucket")
    return side(first, "t", "i", "u", "j", 0, "label").union(side(joined.join(sizes, "bucket"), "u", "j", "t", "i", 1, "pivot_label"))


def tiles_within(rest: DataFrame, number: int) -> DataFrame:
    """Tiles of rest (bucket, n, node, label): every node with every other one of its bucket."""
    own = F.pmod(F.xxhash64("node"), F.col("t")).cast("int")
    dealt = rest.withColumn("t", F.ceil(F.col("n") / TILE).cast("int")).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    return dealt.select("bucket", F.lit(number).alias("round"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side, "node", "label")


def compare_tiles(tiles: DataFrame, contents: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join different labels, from tiles (bucket, round, i, j, side, node, label). Tiles are dealt to groups of
    about DEALT rows; a tile has 2 * TILE at most."""
    groups = shards(tiles.count(), DEALT)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, tile in part.sort_values("node", kind="stable").groupby(["bucket", "round", "i", "j"], sort=False):
            nodes, labels = tile["node"].to_numpy(), tile["label"].tolist()
            if len(set(labels)) > 1:
                found += [(nodes[p], nodes[q]) for p, q in joining_links(list(tile["hashes"]), labels, tile["side"].to_numpy(), similarity)]
        return pd.DataFrame({"a": [f[0] for f in found], "b": [f[1] for f in found]}, dtype="i8")

    dealt = tiles.withColumn("group", F.pmod(F.xxhash64("bucket", "round", "i", "j"), F.lit(groups)))
    return dealt.join(contents, "node").groupBy("group").applyInPandas(compare, "a long, b long")


def near_duplicate_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, size: int = SIZE, bands: int = BANDS, rows: int = ROWS, similarity: float = SIMILARITY, row: str | None = None
) -> DataFrame:
    """(row, id, first_row, first_id) of every row of docs: row numbers those of the column row, or numbers given here;
    first_row and first_id those of the class's first row by id (nulls last) and row number."""
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    numbered = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    numbered = numbered.withColumn("md5", F.unhex(F.md5("text")))
    rows_df = scratch.stored(with_sketch(numbered, "text", bands, rows, size).drop("text"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    nodes = rows_df.where("md5 is not null").groupBy("md5").agg(F.min(order).alias("first"), F.first("keys").alias("keys"))
    nodes = scratch.stored(nodes.withColumn("node", F.monotonically_increasing_id()))

    buckets = nodes.select("node", F.explode("keys").alias("bucket"))
    members = buckets.join(crowds(buckets.withColumn("label", F.col("node"))), "bucket")
    members = scratch.stored(members.select("bucket", "node", "pivot").where("node <> pivot"))
    met = scratch.stored(members.select("node").union(members.select("pivot")).distinct())
    wanted = nodes.join(met, "node").select("node", F.col("md5").alias("_md5"), F.col("first.id").alias("_id"), F.col("first.row").alias("_row"))
    if row:  # docs may be bucketed by it: then texts stay where they are
        texts = numbered.hint("merge").join(wanted, F.col("row") == F.col("_row"))
    else:  # one row of each text; texts are told apart by id too, so that a text with many rows is no hot key
        met_text = (F.col("md5") == F.col("_md5")) & F.col("id").eqNullSafe(F.col("_id"))
        texts = numbered.where("md5 is not null").hint("merge").join(wanted, met_text).dropDuplicates(["md5", "id"])
    contents = scratch.bucketed(texts.select("node", hashes_of(size)("text").alias("hashes")), "node", shards(met.count(), BUCKETED, 12))

    least, reach = similarity - 1e-9, 2 * similarity - 1 - 1e-9
    links, tiles = [], []
    labels = None
    for pivots in range(PIVOTS):
        sims = scratch.stored(similarities(members.select("node", "pivot").distinct(), contents))
        links.append(sims.where(F.col("sim") >= least).select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        labels = components(reduce(DataFrame.union, links if labels is None else [links[-1], labels.toDF("a", "b")]), scratch)
        of = labels.withColumnRenamed("label", "of")
        left = members.join(sims.where(F.col("sim") < least), ["node", "pivot"]).join(of, "node", "left").withColumn("label", F.coalesce("of", "node")).drop("of")
        left = left.join(of.withColumnRenamed("node", "pivot"), "pivot", "left").withColumn("pivot_label", F.coalesce("of", "pivot")).drop("of")
        left = scratch.stored(left)
        between = left.where((F.col("sim") >= reach) & (F.col("label") != F.col("pivot_label")))
        if between.limit(1).count():
            tiles.append(scratch.stored(tiles_between(between, members, sims.where(F.col("sim") >= least), 2 * pivots)))
        rest = scratch.stored(left.drop("pivot").join(crowds(left, "n > 1 and low <> high"), "bucket").select("bucket", "node", "pivot", "n", "label"))
        large = F.col("n") > (TILE if pivots + 1 < PIVOTS else 2**62)
        n_small, n_large = rest.agg(F.count_if(~large), F.count_if(large)).first()
        if n_small:
            tiles.append(scratch.stored(tiles_within(rest.where(~large), 2 * pivots + 1)))
        if not n_large:
            break
        members = rest.where(large & (F.col("node") != F.col("pivot"))).select("bucket", "node", "pivot")
    if tiles:
        more = scratch.stored(compare_tiles(reduce(DataFrame.union, tiles), contents, similarity))
        labels = components(more.union(labels.toDF("a", "b")), scratch)

    named = nodes.join(labels, "node", "left").select("md5", "first", F.coalesce("label", "node").alias("label"))
    firsts_of = named.groupBy("label").agg(F.min("first").alias("top"))
    by_text = named.select("md5", "label").join(firsts_of, "label").select("md5", "top")
    joined = rows_df.select("row", "id", "md5").join(by_text, "md5", "left")
    return scratch.cleared(
        joined.select("row", "id", F.coalesce("top.row", "row").alias("first_row"), F.when(F.col("top").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("first_id"))
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the first row of each class alone. Row numbers are written once with the rows, as numbers of two scans
    differ where the splits do, in a table bucketed by them: both joins on them leave the texts where they are. That
    table stays in the session's catalogue and in the shared folder, as the result is read from it."""
    scratch, number = Scratch(docs.sparkSession, "rows"), fresh(docs, "row")
    rows = scratch.bucketed(docs.withColumn(number, F.monotonically_increasing_id()), number, shards(docs.count(), 2 * BUCKETED, 12))
    classes = near_duplicate_classes(rows, key, text, row=number)
    kept = classes.where(F.col("row") == F.col("first_row")).select(F.col("row").alias(number))
    return rows.hint("merge").join(kept, number, "left_semi").drop(number)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), F.col("first_id").alias("class_id"))

r"""Spelling variants: words of a corpus that are one inserted, deleted or replaced code point apart, by pivotal grams.

A word's bigrams are ordered by how many words have them, rare first. The prefix of a word is its three rarest bigrams
(and whatever ties with the third by gram); by dynamic programming two of those that don't overlap, of the least total
frequency, become its pivots. One edit leaves at least one of two disjoint pivots whole, and, where the other word's
prefix reaches as far in the order, that pivot is in it. So pivots of each word are matched with prefixes of the others,
in both directions, under the position limits of one edit: a pivot that is moved by one place belongs to a word longer or
shorter by one, and the edit lies on one side of the pivot, so that the other side is equal. That side is part of the
key, which keeps common grams from gathering many words. What matches is verified by edit distance.

Counting words is one aggregation with partial counts in each task. Grams are pairs of an alphabet of 90 letters, so that
their counts have 8,100 rows at most and are broadcast. Everything else is joins of tables of distinct words.

Defined results: a null text has no words; a null key counts as an empty text in the checksum; rows that repeat count
each time; ties of forms go to the smaller word in code-point order; an empty table gives an empty result; other columns
aren't read. Words of fewer than `shortest` code points are left out, before and after a code point is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, table

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of a gram, edits, and grams of a prefix: one more than edits can touch.
Q, EDITS = 2, 1
PREFIX = Q * EDITS + 1
#: Jumps of a root's search: a form is at least five times as frequent, so that 2^5 steps exceed any 64-bit count.
JUMPS = 5


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = 6, least: int = 5, typo: int | None = 199) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least `shortest` code points that occur `least` times or more.
    typo: where the CRC-32 of ``key:run`` is divisible by it, that checksum's code point of the run is deleted first."""
    key = F.coalesce(F.col(id).cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all(text, F.lit(f"({LETTERS})"), F.lit(1))).alias("run"))
    runs = runs.where(F.length("run") >= shortest)
    word = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    if typo is not None:
        runs = runs.select(word.alias("run"), F.crc32(F.concat("key", F.lit(":"), word)).alias("h"))
        at = F.pmod("h", F.length("run").cast("long")).cast("int")
        cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        word = F.when(F.col("h") % typo == 0, cut).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def grams_of(word: str) -> list[str]:
    return [word[i : i + Q] for i in range(len(word) - Q + 1)]


def prefix_of(word: str, order: dict[str, int]) -> tuple[list[int], int]:
    """Places of the PREFIX rarest grams, and of others equal to the last of those; and that gram's number in the order."""
    numbers = [order[g] for g in grams_of(word)]
    last = sorted(numbers)[min(PREFIX, len(numbers)) - 1]
    return [i for i, x in enumerate(numbers) if x <= last], last


def pivots_of(places: list[int], costs: list[int], parts: int = EDITS + 1) -> list[int]:
    """`parts` of the ascending places, no two closer than Q, of least total cost: best[k] is the cheapest choice of k
    among the places seen, with the place it ends at; ties go to earlier places. Empty if there is no such choice."""
    table: list[list[tuple[int, tuple[int, ...]] | None]] = []  # for each place: the cheapest choices of k up to it
    for i, (place, cost) in enumerate(zip(places, costs, strict=True)):
        row = list(table[-1]) if table else [(0, ()), *[None] * parts]
        before = next((table[j] for j in range(i - 1, -1, -1) if place - places[j] >= Q), [(0, ()), *[None] * parts])
        for k in range(1, parts + 1):
            if before[k - 1] is not None:
                made = (before[k - 1][0] + cost, (*before[k - 1][1], place))
                row[k] = made if row[k] is None else min(row[k], made)
        table.append(row)
    return list(table[-1][parts][1]) if table and table[-1][parts] else []


KEYS = "pivot boolean, gram string, place int, length int, left boolean, rest string, last int, word string, n long"


def keys_of(word: str, order: dict[str, int], freq: dict[str, int]) -> Iterator[tuple]:
    """Index rows of a word. A prefix row says where its gram stands, and the word up to or from it. A pivot row says the
    same of the word that it looks for: equal up to the gram, with the edit behind it, or from it, with the edit before."""
    places, last = prefix_of(word, order)
    size = len(word)
    for p in places:
        yield False, word[p : p + Q], p, size, True, word[: p + Q], last
        yield False, word[p : p + Q], p, size, False, word[p:], last
    for p in pivots_of(places, [freq[word[p : p + Q]] for p in places]):
        for longer in (-1, 0, 1):
            yield True, word[p : p + Q], p, size + longer, True, word[: p + Q], last
            if p + longer >= 0:
                yield True, word[p : p + Q], p + longer, size + longer, False, word[p:], last


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other, other_n): words (word, n), distinct and of five code points or more, with each word that is one edit
    away; both directions."""
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - Q + 1), lambda i: F.substr(F.col("word"), i, F.lit(Q)))))
    counted = words.select(grams.alias("gram")).groupBy("gram").agg(F.count("*").alias("f"))
    ranked = sorted((r.f, r.gram) for r in counted.collect())  # pairs of letters of a fixed alphabet
    session = words.sparkSession.sparkContext
    shared = session.broadcast(({g: i for i, (_, g) in enumerate(ranked)}, {g: f for f, g in ranked}))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order, freq = shared.value
        for batch in batches:
            for at in range(0, len(batch), 4_096):
                some = batch.iloc[at : at + 4_096]
                rows = [(*key, w, n) for w, n in zip(some["word"], some["n"], strict=True) for key in keys_of(w, order, freq)]
                yield pd.DataFrame(rows, columns=["pivot", "gram", "place", "length", "left", "rest", "last", "word", "n"])

    keys = words.mapInPandas(index, KEYS)
    on = ["gram", "place", "length", "left", "rest"]
    pivots = keys.where("pivot").select(*on, F.col("last").alias("p_last"), F.col("word").alias("p_word"), F.col("n").alias("p_n"))
    prefixes = keys.where(~F.col("pivot")).select(*on, "last", "word", "n")
    reaches = (F.col("last") >= F.col("p_last")) & (F.levenshtein("word", "p_word", 1) == 1)
    met = pivots.join(prefixes, on).where(reaches).select("word", "n", "p_word", "p_n")
    ways = F.explode(F.array(F.struct(F.col("word"), F.col("p_word").alias("other"), F.col("p_n").alias("other_n")), F.struct(F.col("p_word").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return met.select(ways.alias("way")).select("way.*").distinct()


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """words (word, n) with n_near, form, form_n and root: the form is the near word of largest n, if that is at least
    `times` the word's own n; the root is what forms lead to. words must be a stored table."""
    best = F.min(F.struct((-F.col("other_n")).alias("down"), F.col("other").alias("other")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    met = words.join(near, "word", "left")
    fits = -F.col("best.down") >= times * F.col("n")
    scratch = Scratch(words.sparkSession, "spelling")
    found = scratch.stored(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.down")).alias("form_n")))
    jumps = found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(JUMPS):  # after each, a root is twice as many steps away, or the last
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumps = scratch.stored(jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    rooted = found.join(jumps, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return scratch.cleared(rooted.select("word", "form", "root", "n", "n_near", "form_n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "words")
    words = scratch.stored(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return scratch.cleared(variants(words))


OP13_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT CAST(i AS UBIGINT) AS i, 0 AS k, CAST(i AS UBIGINT) AS c FROM range(256) AS t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS key, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), lowered AS (
  SELECT key, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS m
  FROM runs WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
  SELECT run, m, list_transform(string_split(key || ':' || run, ''), lambda x: CAST(unicode(x) AS UBIGINT)) AS points FROM lowered
), checked AS (
  SELECT run, m, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(points, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END))),
    lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS h
  FROM bytes, tab
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, CAST(sum(m) AS BIGINT) AS n
  FROM checked GROUP BY word HAVING length(word) >= 6 AND sum(m) >= 5
), cut AS (
  SELECT word, n, i, left(word, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS less FROM words, range(length(word)) AS t(i)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.less = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.less = w.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT k.word, k.next, f.form FROM walk k JOIN forms f ON f.word = k.next
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM walk WHERE next IS NULL) USING (word)
"""

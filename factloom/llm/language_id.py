"""Language identification of words and texts by a linear-chain conditional random field.

The states are the languages. A word's features are its prefixes and suffixes of one to three characters, its character
pairs and triples with its edges, and, as a lexicon, the whole word; all are hashed into 2^18 buckets. They depend on
the word alone, so that a worker keeps the scores of words that it has met. Transitions and first states are learned
with them. Words are labelled by forward-backward over whole texts. A text's language is the one with the highest mean
probability over its words, and that mean is its score; runs of words with one label are given beside it.

Training takes a bounded sample of the texts with a known language and a letter, whole, on the driver: of each language
the `rows_per_language` rows with the smallest hashes of key and text, of at most LONGEST characters where it has such.
That is the only bound here: 160 texts of 100,000 characters are 16 million characters a language at most.
Sequences for training are spliced from snippets of one to several languages, so that switches between languages occur
and their cost is learned. Only the fit is bounded; every text is labelled whole.

Defined results: a text that is null or has no letters is `und` with score 0; texts of any length are labelled whole;
repeated rows get the same result; with one known language all texts with letters get it, with none `und`; ties between
languages go to the first by name. Other columns are kept; columns of the output's names are replaced.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import fresh, held_out, mix64, table, text_runs

BITS, ROWS_PER_LANGUAGE = 18, 160
WORD = regex.compile(r"\p{L}+")
UNKNOWN = "und"
#: Characters of a text of the training sample, where a language has texts as short.
LONGEST = 100_000
#: Words of a long text that advance as one piece, and words whose scores a worker keeps.
PIECE, KEPT = 128, 400_000


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the affixes, character n-grams and whole forms of the words, word by word; what occurs
    twice counts twice."""
    lengths = np.fromiter(map(len, words), "i8", len(words)) + 2
    signs = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "u4").astype("u8")
    owner, begin = np.repeat(np.arange(len(words)), lengths), np.cumsum(lengths) - lengths
    end, place = begin + lengths, np.arange(len(signs)) - begin[owner]
    owners, hashes = [], []

    def add(who: np.ndarray, starts: np.ndarray, size: int, kind: int) -> None:
        hashed = np.full(len(starts), kind, "u8")
        for k in range(size):
            hashed = mix64(hashed * np.uint64(3) + signs[starts + k])
        owners.append(who)
        hashes.append(hashed)

    for size in (2, 3):  # with the edges
        starts = np.flatnonzero(place + size <= lengths[owner])
        add(owner[starts], starts, size, 1)
    for size in (1, 2, 3):
        long = np.flatnonzero(lengths - 2 >= size)
        add(long, begin[long] + 1, size, 2)
        add(long, end[long] - 1 - size, size, 3)
    owners.append(np.arange(len(words)))
    hashes.append(mix64(np.add.reduceat(mix64(signs + (place.astype("u8") << np.uint64(32))), begin)) if len(words) else np.empty(0, "u8"))
    owner, buckets = np.concatenate(owners), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype("i8")
    order = np.argsort(owner, kind="stable")
    return owner[order], buckets[order]


@dataclass
class Crf:
    """languages; weights[bucket, language], transitions[from, to], first[language]."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray
    known: dict[str, bytes] | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": None}

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of the words, one row each; those of words met before are kept."""
        if self.known is None:
            self.known = {}
        met = set(words)
        missing = met - self.known.keys()
        if len(self.known) + len(missing) > KEPT:
            self.known, missing = {}, met
        if missing:
            self._learn(list(missing))
        get = self.known.__getitem__
        return np.frombuffer(b"".join(map(get, words)), "f4").reshape(len(words), len(self.languages))

    def _learn(self, words: list[str]) -> None:
        width = 4 * len(self.languages)
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            owner, buckets = word_features(some)
            held = self.weights[buckets]
            rows = np.stack([np.bincount(owner, held[:, k], len(some)) for k in range(held.shape[1])], 1).astype("f4").tobytes()
            self.known.update((w, rows[i * width : (i + 1) * width]) for i, w in enumerate(some))

    def marginals(self, sequences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(probability of every language for every word, where each sequence begins and the last ends)."""
        lengths = np.array([len(s) for s in sequences], "i8")
        bounds = np.concatenate([np.zeros(1, "i8"), np.cumsum(lengths)])
        if not bounds[-1]:
            return np.empty((0, len(self.languages))), bounds
        scores = np.exp(np.clip(self.emissions([w for s in sequences for w in s]).astype("f8"), -60, 60))
        trans, first = np.exp(np.clip(self.transitions, -60, 60)), np.exp(np.clip(self.first, -60, 60))
        return posteriors(scores, bounds, trans, first), bounds

    def label(self, texts: list[str]) -> list[tuple[str, float, list[dict]]]:
        """(language, score, runs of words in one language) of every text."""
        if not self.languages:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        found, bounds = self.marginals([WORD.findall(t.lower()) for t in texts])
        best = found.argmax(1)
        changes = np.flatnonzero(np.diff(best)) + 1
        cuts = np.unique(np.concatenate([bounds, changes]))
        at = np.searchsorted(cuts, bounds)
        out = []
        for i in range(len(texts)):
            begin, end = int(bounds[i]), int(bounds[i + 1])
            if begin == end:
                out.append((UNKNOWN, 0.0, []))
                continue
            mean = found[begin:end].mean(0)
            top = int(mean.argmax())
            own = cuts[at[i] : at[i + 1] + 1].tolist()
            runs = [{"lang": self.languages[best[s]], "start": s - begin, "end": e - begin} for s, e in zip(own, own[1:])]
            out.append((self.languages[top], float(min(1.0, mean[top])), runs))
        return out


def posteriors(scores: np.ndarray, bounds: np.ndarray, trans: np.ndarray, first: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Forward-backward over sequences that lie one after the other in scores, cut into pieces that advance together, one
    word at a time. For sequences of several pieces, the product of each piece's steps gives the vectors that enter the
    next piece and the one before; these are carried from piece to piece."""
    states, lengths = scores.shape[1], np.diff(bounds)
    pieces = -(-lengths // piece)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = bounds[owner] + number * piece
    sizes = np.minimum(piece, bounds[owner + 1] - starts)
    enter, leave = np.tile(first, (len(owner), 1)), np.ones((len(owner), states))
    several = np.flatnonzero(pieces[owner] > 1)
    if len(several):
        product = scores[starts[several], :, None] * np.eye(states)
        for t in range(1, int(sizes[several].max())):
            live = np.flatnonzero(sizes[several] > t)
            step = (product[live].reshape(-1, states) @ trans).reshape(-1, states, states) * scores[starts[several[live]] + t][:, None, :]
            product[live] = step / step.max((1, 2), keepdims=True)
        row = np.full(len(owner), -1)
        row[several] = np.arange(len(several))
        for k in range(1, int(pieces.max())):
            here = np.flatnonzero(number == k)
            entered = np.einsum("ij,ijk->ik", enter[here - 1], product[row[here - 1]]) @ trans
            enter[here] = entered / entered.sum(1, keepdims=True)
        for k in range(int(pieces.max()) - 1, 0, -1):
            here = np.flatnonzero(number == k)
            left = np.einsum("ijk,ik->ij", product[row[here]], leave[here]) @ trans.T
            leave[here - 1] = left / left.sum(1, keepdims=True)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, enter, leave = starts[order], sizes[order], enter[order], leave[order]
    live = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")  # pieces longer than t
    out = np.empty((len(scores), states))
    alpha = enter
    for t, n in enumerate(live):
        alpha = (alpha if t == 0 else alpha[:n] @ trans) * scores[starts[:n] + t]
        alpha /= alpha.sum(1, keepdims=True)
        out[starts[:n] + t] = alpha
    beta = np.empty((0, states))
    for t in range(len(live) - 1, -1, -1):
        n, ahead = live[t], len(beta)
        if ahead:
            beta = (beta * scores[starts[:ahead] + t + 1]) @ trans.T
            beta /= beta.sum(1, keepdims=True)
        beta = np.concatenate([beta, leave[ahead:n]])
        out[starts[:n] + t] *= beta
    return out / out.sum(1, keepdims=True)


def fit_crf(rows: list[tuple[list[str], str]], epochs: int = 6, rate: float = 0.5, l2: float = 1e-6, batch: int = 64, seed: int = 7) -> Crf:
    """Maximum likelihood by AdaGrad over batches of spliced sequences; the gradient is observed minus expected counts."""
    languages = sorted({lang for _, lang in rows})
    states = len(languages)
    model = Crf(languages, np.zeros((1 << BITS, states), "f4"), np.zeros((states, states)), np.zeros(states))
    if states < 2:
        return model
    of, pick = {lang: i for i, lang in enumerate(languages)}, random.Random(seed)
    vocabulary: dict[str, int] = {}
    snippets = []
    for words, lang in rows:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        snippets += [(ids[i : i + 12], of[lang]) for i in range(0, len(ids), 12)]
    owner, buckets = word_features(list(vocabulary))
    lists = np.split(buckets, np.searchsorted(owner, np.arange(1, len(vocabulary))))
    gw, gt, gf = np.full((1 << BITS, states), 1e-8), np.full((states, states), 1e-8), np.full(states, 1e-8)
    for _ in range(epochs):
        pick.shuffle(snippets)
        sequences = []
        at = 0
        while at < len(snippets):
            take = pick.choice((1, 1, 2, 3))
            part = snippets[at : at + take]
            at += take
            sequences.append(([i for ids, _ in part for i in ids], [s for ids, s in part for _ in ids]))
        for b in range(0, len(sequences), batch):
            some = [s for s in sequences[b : b + batch] if s[0]]
            if not some:
                continue
            ids = np.array([i for s, _ in some for i in s])
            gold = np.array([y for _, ys in some for y in ys])
            lengths = np.array([len(s) for s, _ in some])
            uniq, where = np.unique(ids, return_inverse=True)
            buckets = np.concatenate([lists[u] for u in uniq])
            sizes = np.array([len(lists[u]) for u in uniq])
            bounds = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            emit = np.add.reduceat(model.weights[buckets], bounds, axis=0)[where].astype("f8")
            posterior, pairs = _expected(emit, lengths, model.transitions, model.first)
            residual = -posterior
            residual[np.arange(len(gold)), gold] += 1
            starts = np.cumsum(lengths) - lengths
            inner = np.ones(len(gold), bool)
            inner[starts] = False
            to = np.flatnonzero(inner)
            observed = np.zeros((states, states))
            np.add.at(observed, (gold[to - 1], gold[to]), 1)
            word_grad = np.zeros((len(uniq), states))
            np.add.at(word_grad, where, residual)
            touched, inverse = np.unique(buckets, return_inverse=True)
            grad = np.zeros((len(touched), states))
            np.add.at(grad, inverse, np.repeat(word_grad, sizes, axis=0))
            grad = grad / len(some) - l2 * model.weights[touched]
            gw[touched] += grad * grad
            model.weights[touched] += (0.2 * rate * grad / np.sqrt(gw[touched])).astype("f4")
            g = (observed - pairs) / len(some)
            gt += g * g
            model.transitions += rate * g / np.sqrt(gt)
            g = residual[starts].sum(0) / len(some)
            gf += g * g
            model.first += rate * g / np.sqrt(gf)
    return model


def _expected(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of every word, expected transitions) of a batch of sequences, padded to the longest."""
    n, t, k = len(lengths), int(lengths.max()), emit.shape[1]
    padded, mask = np.zeros((n, t, k)), np.arange(t)[None, :] < lengths[:, None]
    padded[mask] = emit
    scores, trans = np.exp(padded - padded.max(2, keepdims=True)), np.exp(transitions)
    alpha, beta = np.empty((n, t, k)), np.ones((n, t, k))
    alpha[:, 0] = np.exp(first) * scores[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        alpha[:, i] = (alpha[:, i - 1] @ trans) * scores[:, i]
        alpha[:, i] /= alpha[:, i].sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        ahead = (beta[:, i + 1] * scores[:, i + 1]) @ trans.T
        ahead /= ahead.sum(1, keepdims=True)
        beta[:, i] = np.where(mask[:, i + 1, None], ahead, 1.0)
    posterior = alpha * beta
    posterior /= posterior.sum(2, keepdims=True)
    joint = alpha[:, :-1, :, None] * trans[None, None] * (scores[:, 1:] * beta[:, 1:])[:, :, None, :]
    joint /= np.maximum(joint.sum((2, 3), keepdims=True), 1e-300)
    return posterior[mask], (joint * mask[:, 1:, None, None]).sum((0, 1))


def train_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", *, rows_per_language: int = ROWS_PER_LANGUAGE) -> Crf:
    """Fits on a bounded sample of the rows with a language whose key is not held out, on whole texts."""
    rows = docs.where(F.col(lang).isNotNull() & ~held_out(key) & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 40)).alias("hash"), (F.length(text) <= LONGEST).alias("short"))
    # languages are the states of the model, which the driver holds: their counts fit it too
    counts = rows.groupBy("lang").agg(F.count_if("short").alias("short"), F.count("*").alias("n")).collect()
    if not counts:
        return fit_crf([])
    # rows under a hash bound, so many that nearly always enough of a language come; of those the first by hash
    bound = {r["lang"]: min(1.0, 1.2 * rows_per_language / (r["short"] or r["n"])) for r in counts}
    long = [r["lang"] for r in counts if not r["short"]]
    bounds = F.element_at(F.create_map(*(F.lit(x) for pair in bound.items() for x in pair)), F.col("lang"))
    fits = F.col("short") | F.col("lang").isin(long) if long else F.col("short")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "text"))
    picked = rows.where(fits & (F.col("hash") < bounds * F.lit(float(1 << 40)))).withColumn("n", first).where(F.col("n") <= rows_per_language)
    picked = picked.select("lang", "text", "hash").toArrow()
    sample = sorted(zip(picked["hash"].to_pylist(), picked["lang"].to_pylist(), picked["text"].to_pylist(), strict=True))
    return fit_crf([(words, lang_) for _, lang_, text_ in sample if (words := WORD.findall(text_.lower()))])


def label_languages(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and runs: array of (lang, start, end) over the text's words, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("struct<lang_pred:string,score:double,runs:array<struct<lang:string,start:int,end:int>>>")
    def label(texts: pa.Array) -> pa.Array:
        out = []
        for plain in text_runs(texts):
            out += shared.value.label(plain)
        return pa.StructArray.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], run)], ["lang_pred", "score", "runs"])

    held = fresh(docs, "label")
    return docs.withColumn(held, label(F.col(text))).withColumns({n: F.col(held)[n] for n in ("lang_pred", "score", "runs")}).drop(held)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = label_languages(docs.select("doc_id", "text"), train_languages(docs))
    return labelled.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", F.transform("runs", lambda r: F.concat_ws(":", r["lang"], r["start"], r["end"])).alias("runs"))

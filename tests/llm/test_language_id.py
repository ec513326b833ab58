import itertools
import random

import numpy as np
import pytest

from factloom.llm import language_id as g


def model():
    rng = np.random.default_rng(1)
    return g.Crf(["aa", "bb", "cc"], rng.normal(0, 0.7, (1 << 18, 3)).astype("f4"), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))


@pytest.mark.parametrize("piece", [1, 2, 3, 128])
def test_forward_backward_equals_enumeration(monkeypatch, piece):
    """Whole and in pieces."""
    monkeypatch.setattr(g.posteriors, "__defaults__", (piece,))
    m = model()
    sequences = [["one", "two", "three", "four", "two", "x"], [], ["one"], ["x", "yy", "two"]]
    found, bounds = m.marginals(sequences)
    for words, a, b in zip(sequences, bounds, bounds[1:], strict=False):
        got = found[a:b]
        scores = m.emissions(words).astype("f8") if words else np.empty((0, 3))
        total, sums = 0.0, np.zeros((len(words), 3))
        for path in itertools.product(range(3), repeat=len(words)) if words else ():
            e = m.first[path[0]] + sum(scores[i, s] for i, s in enumerate(path)) + sum(m.transitions[a, b] for a, b in zip(path, path[1:]))
            total += np.exp(e)
            for i, s in enumerate(path):
                sums[i, s] += np.exp(e)
        assert np.allclose(got, sums / total if words else sums)


def test_gradient_statistics_equal_marginals():
    m = model()
    words = [["one", "two", "three"], ["four", "one"]]
    emit = np.concatenate([m.emissions(w) for w in words]).astype("f8")
    posterior, pairs = g._expected(emit, np.array([3, 2]), m.transitions, m.first)
    assert np.allclose(posterior, m.marginals(words)[0], atol=1e-6)
    assert np.isclose(pairs.sum(), 3)


def test_gradient_equals_differences_of_the_likelihood():
    """Observed minus expected counts, which the fit follows, against the log-likelihood by enumeration."""
    m, words, gold = model(), ["one", "two", "three", "one"], [0, 2, 1, 1]

    def score(path, emit, trans, first):
        return first[path[0]] + sum(emit[i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))

    def likelihood(emit, trans, first):
        return score(gold, emit, trans, first) - np.log(sum(np.exp(score(p, emit, trans, first)) for p in itertools.product(range(3), repeat=len(words))))

    emit = m.emissions(words).astype("f8")
    posterior, pairs = g._expected(emit, np.array([4]), m.transitions, m.first)
    for a, b in itertools.product(range(3), repeat=2):
        more = m.transitions.copy()
        more[a, b] += 1e-5
        observed = sum((x, y) == (a, b) for x, y in zip(gold, gold[1:]))
        assert abs((likelihood(emit, more, m.first) - likelihood(emit, m.transitions, m.first)) / 1e-5 - (observed - pairs[a, b])) < 1e-3
    for i, s in itertools.product(range(4), range(3)):
        more = emit.copy()
        more[i, s] += 1e-5
        assert abs((likelihood(more, m.transitions, m.first) - likelihood(emit, m.transitions, m.first)) / 1e-5 - ((gold[i] == s) - posterior[i, s])) < 1e-3


VOCAB = {"xx": ["karo", "kimo", "kulta", "kesto"], "yy": ["salu", "soreb", "sinot", "sumal"], "zz": ["trink", "trast", "trolm", "trelp"]}


def texts(rng, lang, n):
    return " ".join(rng.choice(VOCAB[lang]) + rng.choice(["a", "i", "u"]) for _ in range(n))


def test_learns_languages_and_labels_switches():
    rng = random.Random(3)
    rows = [(texts(rng, lang, 24).split(), lang) for lang in VOCAB for _ in range(40)]
    m = g.fit_crf(rows)
    mixed = texts(rng, "xx", 8).split() + texts(rng, "zz", 8).split()
    got = m.marginals([mixed])[0].argmax(1)
    want = [m.languages.index("xx")] * 8 + [m.languages.index("zz")] * 8
    assert (got == want).mean() >= 0.9
    assert m.transitions.diagonal().min() > (m.transitions.sum() - m.transitions.trace()) / 6


def test_held_out_accuracy(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, texts(rng, lang := rng.choice(list(VOCAB)), rng.randint(1, 40)), lang) for i in range(300)] + [(900, None, "xx"), (901, "123 !!", "yy"), (902, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in g.op6_language_id(spark, str(tmp_path)).collect()}
    held = [got[i].lang_pred == lang for i, _, lang in rows[:300] if got[i].held_out]
    assert len(held) > 30 and sum(held) / len(held) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_documents(odd_docs, no_docs):
    m = g.train_languages(odd_docs)
    rows = g.label_languages(odd_docs, m).collect()
    assert len(rows) == odd_docs.count() and {r.lang_pred for r in rows} <= {"und", "en", "fr", "de", "es"}
    none = g.train_languages(no_docs)
    assert {r.lang_pred for r in g.label_languages(odd_docs, none).collect()} == {"und"}
    assert g.label_languages(no_docs, m).count() == 0


def test_the_sample_is_bounded_and_of_texts_with_letters(spark, monkeypatch):
    monkeypatch.setattr(g, "LONGEST", 200)
    taken = []
    monkeypatch.setattr(g, "fit_crf", lambda rows: taken.extend(rows) or "model")
    rng = random.Random(6)
    rows = [(7, texts(rng, "xx", 5), "xx")] * 500 + [(7, texts(rng, "xx", 5), "xx") for _ in range(300)] + [(i, None, "xx") for i in range(4000)] + [(i, "123", "yy") for i in range(3000)]
    rows += [(i, texts(rng, "yy", 4), "yy") for i in range(40)] + [(i, "kesto " * 100, "yy") for i in range(40)] + [(i, "salu " * 100, "zz") for i in range(40)]
    assert g.train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=10) == "model"
    by = {lang: [w for w, x in taken if x == lang] for lang in ("xx", "yy", "zz")}
    assert all(5 <= len(by[k]) <= 10 for k in ("yy", "zz")) and len(by["xx"]) <= 10
    assert all(w and len(w) < 100 for w in by["yy"]) and all(len(w) == 100 for w in by["zz"])

import re
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import secret_scan
from factloom.llm.decontamination import words_of

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_take_effect_and_end_packed(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    before, texts = len(ids), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept = {r.doc_id: r.text for r in docs.collect()}
        assert kept.keys() <= ids and len(kept) >= 0.7 * before
        ids, texts[name] = set(kept), kept
    assert len(set(texts["near_dedup"].values())) == len(texts["near_dedup"])
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words_of(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    for t in texts["decontamination"].values():
        w = words_of(t)
        assert not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))
    assert not any(secret_scan.spans_of(t) for t in texts["secrets"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    fill = packed.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 4096 for r in fill) and sum(r[1] for r in fill) / 4096 / len(fill) > 0.9


def test_run_gives_the_stages_rows(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and "corpus_pipeline" in sys.modules


ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", re.I | re.A)


def near(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (words_of(a or ""), words_of(b or "")))
    return bool(a and b) and len(a & b) / len(a | b) >= 0.8 - 1e-9


def classes(rows):
    """Numbers of the classes of equal and near texts, by all pairs."""
    own = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if own[i] != own[j] and ((a is not None and a == b) or near(a, b)):
                own = [own[j] if x == own[i] else x for x in own]
    return own


def without_windows(text, windows):
    """The words of a text that lie in no occurrence of a window, and how many it had."""
    w, hit = words_of(text or ""), set()
    for i in range(len(w)):
        for size in {len(x) for x in windows}:
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
    return [x for i, x in enumerate(w) if i not in hit], len(w)


def test_the_pipeline_equals_a_plain_version(spark, tmp_path):
    docs, texts = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
    rows = sorted(texts["quality"].items())
    own = classes(rows)
    kept = {own[i] for i, (d, _) in enumerate(rows) if d in texts["near_dedup"]}
    assert len(texts["near_dedup"]) == len(kept) == len(set(own)), "one of each class"
    assert len(set(own)) < len(rows) and all(texts["quality"][d] == t for d, t in texts["near_dedup"].items())
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words_of(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} - {()}
    plain = {d: without_windows(t, windows) for d, t in texts["near_dedup"].items()}
    want = {d: left for d, (left, n) in plain.items() if left or not n}
    assert want == {d: words_of(t or "") for d, t in texts["decontamination"].items()} and any(len(left) < n for left, n in plain.values())
    for d, t in texts["secrets"].items():
        before = texts["decontamination"][d]
        secrets = [m[1] for m in ASSIGN.finditer(before or "")]
        assert not any(x in (t or "") for x in secrets), d
        parts = (t or "").split("[REDACTED]")
        assert re.fullmatch(".+?".join(map(re.escape, parts)), before or "", re.S), "nothing but spans was replaced"
        assert len(parts) > 1 or t == before
    assert texts["secrets"].keys() == texts["decontamination"].keys()
    encoder, length = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), {}
    for r in corpus_pipeline.run(spark, SF).collect():
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert length == {d: len(encoder.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts["secrets"].items()}


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    odd_docs.write.parquet(str(tmp_path / "odd"))
    docs = spark.read.parquet(str(tmp_path / "odd"))
    out = run(spark, docs, SF)
    rows = out.collect()
    none = run(spark, no_docs, SF)
    assert none.count() == 0
    if stage == "packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} and "start" in none.columns
        return
    assert out.columns == docs.columns and none.columns == no_docs.columns
    assert 0 < len(rows) <= docs.count() and {r.found[0] for r in rows} == {1} and {r.row for r in rows} == {"r"}
    kept = [r.text for r in rows]
    assert None in kept or stage == "quality"
    if stage == "near_dedup":
        assert len(rows) == docs.count() - 1
    if stage == "secrets":
        assert not any("hunter2hunter2" in (t or "") or "abcdefgh12" in (t or "") for t in kept) and len(rows) == docs.count()

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm.packing import CAPACITY, WordTokenizer, pack_documents, plan_bins

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(texts):
    tok = Tokenizer.from_file(PATH)
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_tokenizers():
    texts = ["", "Don't I'LL we've\t\x1c x  y\n\nz", "<|endoftext|>abc <|startoftext|>", "İstanbul ǅ Σας ΟΔΟΣ. é é ñ 日本語テスト!!", "'s 't''ll !!'s 12a3 ½ ²", "a" * 300, "­soft   line 　 wide"]
    got = WordTokenizer(PATH).ids(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == ids(texts)


def test_caches_that_overflow_give_the_same_ids(monkeypatch):
    monkeypatch.setattr("factloom.llm.packing.WORDS", 3)
    texts = [f"alpha{i} beta{i}! gamma, delta{i % 3}" for i in range(40)]
    tok = WordTokenizer(PATH)
    assert [np.frombuffer(b, "<u4").tolist() for t in texts for b in tok.ids([t])] == ids(texts)


def laid_out(runs):
    places = {}
    for n, rank, count, first, offset in runs:
        for i in range(count):
            places[n, rank + i] = (first + i, offset)
    return places


def test_bins_hold_every_piece_once_without_gaps():
    rng = random.Random(1)
    for capacity in (10, 64, 4096):
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(40)}
        runs, bins = plan_bins(counts, capacity)
        places = laid_out(runs)
        assert sorted(places) == sorted((n, r) for n, c in counts.items() for r in range(c))
        by_bin = {}
        for (n, _), (b, o) in places.items():
            by_bin.setdefault(b, []).append((o, n))
        assert len(by_bin) == bins
        for pieces in by_bin.values():
            at = 0
            for o, n in sorted(pieces):
                assert o == at
                at += n
            assert at <= capacity
            assert sum(3 * n > capacity for _, n in pieces) <= 2
        total = sum(n * c for n, c in counts.items())
        best_fit = first_fit(counts, capacity)
        assert -(-total // capacity) <= bins <= best_fit * 1.1 + 1


def first_fit(counts, capacity):
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [g for g in range(len(gaps)) if gaps[g] >= n]
        if fits:
            gaps[min(fits, key=lambda g: gaps[g])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_odd_documents(odd_docs):
    rows = pack_documents(odd_docs, capacity=CAPACITY).collect()
    want = {}
    for r in odd_docs.select("doc_id", "text").collect():
        all_ids = ids([r.text or ""])[0] + [1]
        for k in range(0, len(all_ids), CAPACITY):
            part = np.array(all_ids[k : k + CAPACITY], "<u4").tobytes()
            want.setdefault((r.doc_id, k // CAPACITY, k, len(part) // 4, zlib.crc32(part)), 0)
            want[r.doc_id, k // CAPACITY, k, len(part) // 4, zlib.crc32(part)] += 1
    got = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_bin.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= CAPACITY


def test_empty_table(no_docs):
    assert pack_documents(no_docs).count() == 0

import hashlib
import math
import random
import re
import string

from factloom.llm import secret_scan as s


def brute(text):
    """The three rules as their definition says them, over the whole text."""
    t = text or ""
    found = [("assign", *m.span()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda x: (x[1], s.KINDS.index(x[0])))


def test_base_rules_equal_brute_force():
    rng = random.Random(3)
    parts = ["password", "PassWd", "token", "api_key", "apikey", "ſecret", "toKen", "=", ":", " ", "'", '"', "\n", "AKIA", "AKIAABCDEFGHIJKL", "deadbeef" * 4, "0f" * 20, "abcdefgh", "é", "x1y2", "😀"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [x for x in s.spans_of(text) if x[0] != "entropy"] == brute(text)


def test_incremental_entropy_equals_direct():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("abcdef0123456789" if rng.random() < 0.5 else string.ascii_letters + string.digits) for _ in range(rng.randint(1, 70)))
        marked = set()
        for i in range(len(text) - s.WINDOW + 1):
            w = text[i : i + s.WINDOW]
            h = -sum(w.count(c) / s.WINDOW * math.log2(w.count(c) / s.WINDOW) for c in set(w))
            hexa = all(c in "0123456789abcdefABCDEF" for c in w)
            digit, low, up = any(c.isdigit() for c in w), any(c.islower() for c in w), any(c.isupper() for c in w)
            least = s.THRESHOLDS["hex"] if hexa and digit and (low or up) else s.THRESHOLDS["mixed"] if digit and low and up else None
            if least is not None and h >= least - 1e-9:
                marked |= set(range(i, i + s.WINDOW))
        got = {p for a, b in s.hot_windows(text) for p in range(a, b)}
        assert got == marked


def test_method_adds_and_allow_list_suppresses():
    assert [k for k, *_ in s.spans_of("key q8Zr2LmT0vXc7Yb1Ns5Kd9Wf here")] == ["entropy"]
    for fine in ("thisisaverylongwordofplainletters", "some-path/of/lower-case/words.and.more", "https://www.site-name.com/a1B2c3D4e5F6g7H8i9", "123456789012345678901234567890", "your_api_EXAMPLE_a1B2c3D4e5F6g7"):
        assert s.spans_of(fine) == []


def test_one_case_tokens_url_paths_and_examples_far_away():
    base36, base32, mixed = "k3v9x0q7m2z8b5t1w6r4", "JBSWY3DPEHPK3PXQ7MZK2TNA", "q8Zr2LmT0vXc7Yb1Ns5Kd9Wf"
    assert s.spans_of(f"key {base36} here") == [("entropy", 4, 24)]
    assert s.spans_of(f"seed {base32} here") == [("entropy", 5, 29)]
    hook = f"https://hooks.slack.com/services/T012AB/B345CD/{mixed}"
    assert s.spans_of(hook) == [("entropy", len(hook) - 24, len(hook))]
    run = f"{mixed}{mixed[::-1]}xxxx{mixed}{mixed[::-1]}"
    assert s.spans_of(run) == [("entropy", 0, 28), ("entropy", 72, 100)]
    assert s.spans_of("https://www.site-name.com/some-plain/words-of-a-long-title/index") == []


def test_redaction_merges_overlaps():
    text = "token=abcdefgh12 and " + "deadbeef" * 4
    assert s.redacted(text, s.spans_of(text)) == "[REDACTED] and [REDACTED]"


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    rows = s.scan_secrets(odd_docs).collect()  # the clashing column is replaced
    for r in rows:
        assert [tuple(x) for x in r.secrets] == s.spans_of(r.text)
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = s.op3_secret_scan(spark, str(tmp_path)).collect()
    assert sorted(r.base_sha256 for r in got) == sorted(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(r.text)).encode()).hexdigest() for r in rows)
    assert sum(r.n_assign for r in got) == 2
    assert s.scan_secrets(no_docs).count() == 0
    assert s.redact_secrets(no_docs).columns == no_docs.columns

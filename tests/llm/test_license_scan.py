import re

import duckdb

from factloom.llm import license_scan as s


def brute(text):
    """(dice, licence) of the outermost passages that match, by loops, without size bounds for templates and anchors."""
    t = text or ""

    def sentences(p):
        return re.sub(r"([.!?])[ \t\r\n]+", "\\1\x01", p).split("\x01")

    sets = s.template_sets(s.TEMPLATES)
    low, high = s.THRESHOLD / (2 - s.THRESHOLD), (2 - s.THRESHOLD) / s.THRESHOLD

    def best(p):
        n, own = len(re.findall(r"[^\W_]+", p.lower())) - 1, set(s.bigram_set(p))
        if not min(len(x) for _, x in sets) * low <= n <= max(len(x) for _, x in sets) * high:
            return None
        scored = [(2 * len(own & set(x)) / (len(own) + len(x)), name) for name, x in sets]
        top = max(x for x, _ in scored)
        return (round(top, 9), min(n for x, n in scored if x == top)) if top >= s.THRESHOLD - 1e-9 else None

    if whole := best(t):
        return [whole]
    found = []
    for block in re.split(r"\r?\n[ \t]*\r?\n", t):
        if m := best(block):
            found.append(m)
            continue
        for line in re.split(r"\r?\n", block):
            m = best(line)
            found += [m] if m else filter(None, map(best, sentences(line)))
        found += filter(None, (best(x) for x in sentences(block) if "\n" in x))
    return sorted(found)


TEXTS = [
    "Released under the MIT License.",
    "Some prose first.\nReleased  under THE mit-license\nand more prose after it",
    s.TEMPLATES["mit"][2],
    s.TEMPLATES["mit"][2].replace("without restriction", "with no\nrestriction"),
    s.TEMPLATES["gpl-3.0"][1].replace(". ", ".\n") + "\n\nUnrelated paragraph of words that go on.",
    "prose of a page\n\nReleased under the MIT License.\n\nmore prose",
    "Some closing words of the page. Released under the MIT License. And more.", "Copyright 2020 Acme Inc. All rights reserved.",
    "First some words.\n\n" + "\n\n".join(re.split(r"(?<=[.]) ", s.TEMPLATES["gpl-3.0"][1])) + "\n\nUnrelated paragraph of words that go on and on.",
    "Before. " + s.TEMPLATES["bsd-2-clause"][2].replace(" AND ", "\nAND ") + " After it, words.",
    "All rights reserved", "All rights", "rights", "", None, "Licensed under CC BY-SA 4.0", "Licensed under CC BY 4.0", "the mit license the mit license", "\n\n \n",
]


def test_equal_to_brute_force(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in s.scan_licences(rows).collect():
        assert sorted((round(m.dice, 9), m.licence) for m in r.licences) == sorted(brute(r.text)), r.text


def test_a_span_counts_once_and_notices_in_prose_are_found(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.text: [m.licence for m in r.licences] for r in s.scan_licences(rows).collect()}
    assert got["prose of a page\n\nReleased under the MIT License.\n\nmore prose"] == ["mit"]
    assert got["Some closing words of the page. Released under the MIT License. And more."] == ["mit"]
    assert got["Copyright 2020 Acme Inc. All rights reserved."] == ["all-rights-reserved"]
    assert {"gpl-3.0"} == {x for t, found in got.items() if t and t.startswith("First some") for x in found}


def test_every_match_holds_an_anchor():
    """More than a third of each template's bigrams hold an anchor, so that a passage that shares two thirds can't lack all."""
    sets = s.template_sets(s.TEMPLATES)
    anchors = set(s.anchors_of(sets, 0.8))
    for _, own in sets:
        assert 3 * sum(bool(anchors & set(b.split())) for b in own) > len(own)


def test_sql_gives_the_same(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("a", odd_docs), ("b", no_docs), ("c", spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = sorted(map(tuple, s.op2_license_scan(spark, str(tmp_path / name)).collect()), key=str)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path / name}/documents.parquet/*.parquet'")
        assert sorted(con.sql(s.OP2_SQL).fetchall(), key=str) == got

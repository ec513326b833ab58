import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        allowed = {("system", None), ("user", None), ("user", "system"), ("user", "assistant"), ("assistant", "user")}
        steps = [(r, turns[i - 1][2] if i else None) for i, (_, _, r, _) in enumerate(turns)]
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss), sum(s not in allowed for s in steps), turns[-1][2] == "assistant")
    return out


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.withColumns({n: F.lit("clash") for n in ("run", "at", "key", "loss", "part", "n", "before")})
    turns = c.turns_of(df)
    order = {r.conv_id: (r.v, r.c) for r in turns.groupBy("conv_id").agg(F.count_if(~F.col("allowed")).alias("v"), F.bool_or("ends").alias("c")).collect()}
    found = c.digests(c.read_back(c.formatted(c.segments(turns)))).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, *order[r.conv_id]) for r in found}


BITS = ["\\", "###", "### ", "#", "</turn>", "</turn>\n", "<", "\n", ": ", "h", "e", "c", "User", "é", "\U0001f600", "=", "\\h", "\\\\e", " ", "\x01", "$1"]


def test_texts_with_control_strings_come_back(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9)))
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "a: b", "=x", "\\c", "", None]
    rows = [(conv, turn, rng.choice(roles) if conv % 2 else roles[turn % 4 + 1], text() if turn % 7 else None) for conv in range(80) for turn in range(rng.randint(1, 9))]
    rows += [(-7, 0, "user", c.TRICKY), (-7, 1, "assistant", c.TRICKY)]
    assert run(spark, rows) == brute(rows)


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark):
    long = "### word\\ " * 60_000
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (None, 1, "assistant", "x"), (1, None, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "assistant", "y"), (2, 0, "user", long), (2, -300, "system", ""), (2, 900, "assistant", long)]
    assert run(spark, rows, extra=True) == brute(rows)
    assert run(spark, []) == {}


def test_a_long_conversation_is_many_runs(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)] + [(3, 700, "user", "u"), (3, 2, "system", "s"), (3, 1500, "assistant", "a")]
    assert run(spark, rows) == brute(rows)
    turns = c.turns_of(spark.createDataFrame(rows, SCHEMA))
    assert turns.select("run").distinct().count() > 5
    assert [r.at for r in turns.where("conv_id = 9").orderBy("at").collect()] == list(range(3000))


def test_segments_say_what_counts_for_the_loss(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b")]
    got = [(r.text, r.loss) for r in c.segments(c.turns_of(spark.createDataFrame(rows, SCHEMA))).orderBy("at", "part").collect()]
    assert got == [("### User: ", False), ("hi", False), ("</turn>\n", False), ("### Assistant: ", False), ("a\\\\b", True), ("</turn>\n", False)]


def test_other_templates_and_bad_ones(spark):
    tmpl = c.Template({"q": c.Role("Q", (None, "a")), "a": c.Role("A", ("q",), loss=True, last=True)}, open="<|", colon="|>", close="<|end|>", controls={"<|": "l"}, in_roles={"|>": "r"})
    rows = [(1, 0, "q", "<|Q|>\\<|end|>"), (1, 1, "a", "<|end|>|>"), (1, 2, "b|>", "x")]
    turns = c.turns_of(spark.createDataFrame(rows, SCHEMA), tmpl)
    read = c.read_back(c.formatted(c.segments(turns, tmpl)), tmpl).first()
    assert [tuple(t) for t in read.turns] == [(r, t) for _, _, r, t in rows] and read.loss == ["<|end|>|>"]
    assert [r.allowed for r in turns.orderBy("at").collect()] == [True, True, False]
    with pytest.raises(ValueError):
        c.Template({}, controls={"###": "h"})
    with pytest.raises(ValueError):
        c.Template({}, controls={"</turn>": "h", "###": "h"})


def test_no_python_runs_on_executors(spark):
    df = c.digests(c.read_back(c.formatted(c.segments(c.turns_of(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA))))))
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))

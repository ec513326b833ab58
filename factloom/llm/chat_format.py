r"""Chat formatting: conversations, given as rows, become segments of text with a loss flag each.

A template says, as data, which mark each role has, after which roles it may stand (a finite-state machine whose state is
the last role), and whether its text counts for the loss. A turn becomes three segments: its mark, its text and the end
of the turn; of those the text alone can carry loss.

Texts and unlisted roles are escaped, so that no control string of the template occurs in them: the escape sign is
doubled, and each control string becomes the escape sign and a letter. Reading back splits at control strings, and undoes
that.

A conversation is cut into runs of RUN turn numbers. Order and places are found within runs first, and a run learns from
a small table of runs how many turns stand before it and which role the turn before it has. So a conversation of any
number of turns is dealt over many tasks. What gathers a whole conversation is only a digest of it, in the query.

Everything here is DataFrame functions; no Python runs on executors.

Defined results: a null text or role is empty; a role that the template doesn't list is kept, has no loss, and is a
violation; a conversation with violations is formatted like others, and the violations are counted; rows stand in order
of turn (null first), then role, then text, so that rows with one turn number keep a fixed order, and repeated rows are
turns of their own; rows with null for a conversation are one conversation with that key; other columns aren't read, and
an empty table gives an empty result. Rows with one turn number of one conversation share a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import table

#: Turn numbers of a run: what one row of formatted text holds.
RUN = 256
#: Marks of roles that the template doesn't list begin with this sign.
OTHER = "="


@dataclass(frozen=True)
class Role:
    mark: str
    #: Roles that may stand before it; None: it may begin a conversation.
    after: tuple[str | None, ...]
    loss: bool = False
    #: Whether a conversation may end with it.
    last: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role]
    open: str = "### "
    colon: str = ": "
    close: str = "</turn>\n"
    escape: str = "\\"
    #: Control strings that may not occur in texts, and the letter that each becomes. A turn is told by `open` at its
    #: begin and `close` at its end, so that one of these must be part of `close`; the last one guards `colon` in roles.
    controls: dict[str, str] = field(default_factory=lambda: {"###": "h", "</turn>": "e"})
    in_roles: dict[str, str] = field(default_factory=lambda: {":": "c"})

    def __post_init__(self):
        letters = [*self.controls.values(), *self.in_roles.values()]
        if len(set(letters)) < len(letters) or any(len(x) != 1 or x == self.escape for x in letters) or len(self.escape) != 1:
            raise ValueError("each control string needs an escape letter of its own")
        if not any(c in self.close for c in self.controls) or not any(c in self.colon for c in self.in_roles):
            raise ValueError("the end of a turn and of a mark must hold a control string")
        if any(self.escape in c or x in c for c in [*self.controls, *self.in_roles] for x in letters):
            raise ValueError("a control string holds the escape sign or an escape letter")
        if any(r.mark.startswith(OTHER) or any(c in r.mark for c in (*self.in_roles, *self.controls)) for r in self.roles.values()):
            raise ValueError("a mark holds a control string")

    def escaped(self, text: Column, role: bool = False) -> Column:
        text = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        for control, letter in (self.controls | self.in_roles if role else self.controls).items():
            text = F.replace(text, F.lit(control), F.lit(self.escape + letter))
        return text

    def unescaped(self, text: Column) -> Column:
        def plain(part: Column) -> Column:  # holds no doubled escape sign
            for control, letter in (self.controls | self.in_roles).items():
                part = F.replace(part, F.lit(self.escape + letter), F.lit(control))
            return part

        return F.array_join(F.transform(F.split(text, quoted(self.escape * 2), -1), plain), self.escape)

    def mark(self, role: Column) -> Column:
        chain = F.concat(F.lit(OTHER), self.escaped(role, True))
        for name, held in self.roles.items():
            chain = F.when(role == name, held.mark).otherwise(chain)
        return chain

    def role_of(self, mark: Column) -> Column:
        chain = self.unescaped(F.substr(mark, F.lit(len(OTHER) + 1)))
        for name, held in self.roles.items():
            chain = F.when(mark == held.mark, name).otherwise(chain)
        return chain

    def allowed(self, role: Column, before: Column) -> Column:
        """Whether the machine has a step from the role before (null: the begin) to this one."""
        chain = F.lit(False)
        for name, held in self.roles.items():
            starts, others = None in held.after, [x for x in held.after if x is not None]
            chain = F.when(role == name, F.when(before.isNull(), F.lit(starts)).otherwise(before.isin(others))).otherwise(chain)
        return chain

    def has_loss(self, role: Column) -> Column:
        return role.isin([name for name, held in self.roles.items() if held.loss])

    def may_end(self, role: Column) -> Column:
        return role.isin([name for name, held in self.roles.items() if held.last])


PLAIN = Template(
    {
        "system": Role("System", (None,)),
        "user": Role("User", (None, "system", "assistant")),
        "assistant": Role("Assistant", ("user",), loss=True, last=True),
    }
)


def quoted(text: str) -> str:
    """A pattern that matches the text alone."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def turns_of(rows: DataFrame, template: Template = PLAIN, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, run, at, role, text, allowed, ends): turns with their number in the conversation, from 0, whether the
    machine allows each there, and, on the last turn, whether the conversation may end so (null on others)."""
    one = F.struct(F.col(conv).alias("conv_id"), F.floor(F.col(turn) / RUN).alias("run"))  # a struct, as nulls in it are equal
    rows = rows.select(one.alias("key"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    rows = rows.withColumns({"in_run": F.row_number().over(order), "before": F.lag("role").over(order)})
    runs = rows.groupBy("key").agg(F.count("*").alias("n"), F.max_by("role", "in_run").alias("last"))
    by_run = Window.partitionBy("key.conv_id").orderBy("key.run")
    earlier = F.coalesce(F.sum("n").over(by_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("key", "n", earlier.alias("earlier"), F.lag("last").over(by_run).alias("last"), F.lead("n").over(by_run).isNull().alias("final"))
    met = rows.join(runs, "key")
    return met.select(
        "key.conv_id", "key.run", (F.col("earlier") + F.col("in_run") - 1).alias("at"), "role", "text",
        template.allowed(F.col("role"), F.coalesce("before", "last")).alias("allowed"),
        F.when(F.col("final") & (F.col("in_run") == F.col("n")), template.may_end(F.col("role"))).alias("ends"),
    )


def segments(turns: DataFrame, template: Template = PLAIN) -> DataFrame:
    """(conv_id, run, at, part, text, loss): mark, escaped text and end of each turn."""
    loss = template.has_loss(F.col("role"))

    def part(text: Column, counts: Column) -> Column:
        return F.struct(text.alias("text"), counts.alias("loss"))

    mark = F.concat(F.lit(template.open), template.mark(F.col("role")), F.lit(template.colon))
    parts = F.array(part(mark, F.lit(False)), part(template.escaped(F.col("text")), loss), part(F.lit(template.close), F.lit(False)))
    return turns.select("conv_id", "run", "at", F.posexplode(parts).alias("part", "held")).select("conv_id", "run", "at", "part", "held.*")


def formatted(parts: DataFrame) -> DataFrame:
    """(conv_id, run, text, spans): segments put together for each run, with the spans (start, end; code points, end
    exclusive) of text that counts for the loss."""
    order = Window.partitionBy("conv_id", "run").orderBy("at", "part")
    placed = parts.withColumn("end", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct((F.col("end") - F.length("text")).alias("start"), F.col("end").alias("end"))
    held = placed.groupBy("conv_id", "run").agg(
        F.array_sort(F.collect_list(F.struct("at", "part", "text"))).alias("parts"), F.array_sort(F.collect_list(F.when(F.col("loss"), span))).alias("spans")
    )
    return held.select("conv_id", "run", F.array_join(F.col("parts.text"), "").alias("text"), "spans")


def read_back(runs: DataFrame, template: Template = PLAIN) -> DataFrame:
    """(conv_id, run, chars, turns, loss): what formatted text says, by its control strings and spans alone: the turns (role,
    text) and the unescaped texts under the loss spans, in order."""
    begin, size = len(template.open) + 1, len(template.colon)
    pieces = F.split("text", quoted(template.close), -1)

    def turn(piece: Column) -> Column:
        colon = F.instr(piece, F.lit(template.colon))
        return F.struct(
            template.role_of(F.substr(piece, F.lit(begin), colon - begin)).alias("role"), template.unescaped(F.substr(piece, colon + size)).alias("text")
        )

    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)
    loss = F.transform("spans", lambda s: template.unescaped(F.substr(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return runs.select("conv_id", "run", F.length("text").alias("chars"), turns.alias("turns"), loss.alias("loss"))


def digests(read: DataFrame) -> DataFrame:
    """One row for each conversation, from read_back: SHA-256 is over one text, so that here a conversation's texts meet."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    runs = read.select("conv_id", "run", "chars", F.size("turns").alias("n"), said.alias("said"), F.array_join("loss", "").alias("loss"))
    held = runs.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("run", "said", "loss"))).alias("runs"))
    said, loss = (F.array_join(F.col(f"runs.{c}"), "") for c in ("said", "loss"))
    return held.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


#: A conversation whose texts hold control strings and escape signs.
TRICKY = r"\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    turns = turns_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky))
    order = turns.groupBy(F.struct("conv_id").alias("key")).agg(F.count_if(~F.col("allowed")).alias("violations"), F.bool_or("ends").alias("complete"))
    found = digests(read_back(formatted(segments(turns)))).withColumn("key", F.struct("conv_id"))
    return found.join(order, "key").drop("key")


OP11_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t.i, CASE t.i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS t(i)
), o AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS escaped,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
      ELSE '=' || replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c') END AS mark,
    coalesce(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant') WHEN 'assistant' THEN before = 'user' END, FALSE) AS allowed
  FROM o
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || mark || ': ' || escaped || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
  count(*) FILTER (NOT allowed) AS violations, bool_or(role = 'assistant' AND place = n) AS complete
FROM f GROUP BY conv_id
"""

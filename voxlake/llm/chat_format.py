"""Chat formatting: a finite-state machine over roles, and a declarative template, in DataFrame functions alone.

Every row becomes segments (text, loss): the turn's opening, its escaped text, its closing; loss holds on the
texts of the template's learned roles. A conversation's segments in turn order make its output; the machine
folds over its roles and says whether turn order is valid. `parse` reads an output back.

Escapes are reversible: a backslash, `<` and `#` of a text, and also `:` of a role, are written as a
backslash and a letter, so no control string can occur inside a text. All text is kept, valid or not.

Defined cases: null text and null role are empty strings; rows of equal turn go by role, then text; null turns
come first; a null conv_id is a conversation of its own; repeated rows are turns as often as they occur; a text of any
length is one segment; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load


@dataclass(frozen=True)
class Template:
    """labels: how a role is written; other roles are written after other_mark. start, moves and final: the
    machine; a role without a move leads to `invalid`, which is never left."""

    open: str = "### "
    after_role: str = ": "
    close: str = "</turn>\n"
    other_mark: str = "@"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learned: tuple = ("assistant",)
    start: str = "start"
    moves: dict = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: tuple = ("assistant",)


TEMPLATE = Template()
INVALID = "invalid"


def _lit(s: str) -> Column:
    return F.lit(s)


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, _lit("\\"), _lit("\\b")), _lit("<"), _lit("\\l")), _lit("#"), _lit("\\h"))


def unescape(c: Column) -> Column:
    # backslashes are written with a letter, so the replacements can go one after the other, theirs last
    return F.replace(F.replace(F.replace(c, _lit("\\h"), _lit("#")), _lit("\\l"), _lit("<")), _lit("\\b"), _lit("\\"))


def role_label(role: Column, t: Template) -> Column:
    known = F.create_map(*[_lit(x) for pair in t.labels.items() for x in pair])
    return F.coalesce(known[role], F.concat(_lit(t.other_mark), F.replace(escape(role), _lit(":"), _lit("\\c"))))


def label_role(label: Column, t: Template) -> Column:
    known = F.create_map(*[_lit(x) for k, v in t.labels.items() for x in (v, k)])
    return F.coalesce(known[label], unescape(F.replace(F.substring(label, F.lit(len(t.other_mark) + 1), F.length(label)), _lit("\\c"), _lit(":"))))


def format_chats(rows: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """rows(conv_id, turn, role, text) -> conv_id, state, valid, segments (array of text, loss), formatted."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    learned = role.isin(*t.learned)
    written = rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), learned.alias("learned"),
        F.concat(_lit(t.open), role_label(role, t), _lit(t.after_role)).alias("head"), escape(text).alias("body"),
    )
    turns = written.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "learned", "head", "body"))).alias("turns"))  # null turns first
    moves = F.create_map(*[_lit(x) for (state, r), to in t.moves.items() for x in (f"{state} {r}", to)])
    state = F.aggregate("turns", _lit(t.start), lambda acc, x: F.coalesce(moves[F.concat(acc, _lit(" "), x["role"])], _lit(INVALID)))
    pieces = F.flatten(F.transform("turns", lambda x: F.array(F.struct(x["head"].alias("text"), F.lit(False).alias("loss")), F.struct(x["body"].alias("text"), x["learned"].alias("loss")), F.struct(_lit(t.close).alias("text"), F.lit(False).alias("loss")))))
    out = turns.select("conv_id", state.alias("state"), pieces.alias("segments"))
    return out.select("conv_id", "state", F.col("state").isin(*t.final).alias("valid"), "segments", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"))


def parse(formatted: Column, t: Template = TEMPLATE) -> Column:
    """An output back to an array of (role, text)."""
    turns = F.slice(F.split(formatted, _quoted(t.close)), 1, F.size(F.split(formatted, _quoted(t.close))) - 1)
    return F.transform(turns, lambda x: _parse_turn(x, t))


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def _parse_turn(x: Column, t: Template) -> Column:
    rest = F.substring(x, F.lit(len(t.open) + 1), F.length(x))
    at = F.instr(rest, t.after_role)
    return F.struct(label_role(F.substring(rest, F.lit(1), at - 1), t).alias("role"), unescape(F.substring(rest, at + len(t.after_role), F.length(rest))).alias("text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(both).alias("text"))
    done = format_chats(rows.unionByName(planted)).withColumn("turns", parse(F.col("formatted")))
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: x["text"]), ""))
    done = done.withColumn("loss_text", loss)
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


#: What op2 returns, for its own template.
OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
lagged AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
    ELSE 1 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) END
    + 2 + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + 8) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END
    AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM lagged GROUP BY conv_id
"""

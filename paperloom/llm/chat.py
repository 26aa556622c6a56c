"""Chat formatting from a declarative template, with per-segment loss flags.

A template names the roles' markers and whether a role's text bears loss; a transition table is the
finite-state machine over roles. A conversation becomes a list of segments (text, loss): marker,
escaped text, end mark for each turn; joined they are the formatted string. Inside texts and roles
backslash, `#`, `<` and `:` are written as backslash plus a letter, so no control string can occur
in a text, and the string can be parsed back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    open: str = "### "
    named: str = ": "
    close: str = " </turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a turn that has no entry leads to `invalid`
    moves: dict = field(default_factory=lambda: {"start": {"system": "primed", "user": "asked"}, "primed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: tuple[str, ...] = ("answered",)


ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escaped(col):
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, col)


def unescaped(col):
    """The backslash is put back last, so that no new pair arises."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), col)


def format_chats(df: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conv_id: conv_id, formatted, segments array<struct<text, loss>>, state, valid.

    Turns go by number; ties go by role, then text. Null roles and texts count as empty; a null
    conv_id is a conversation of its own; an empty table gives an empty table. Conversations whose
    roles break the order are formatted like others and have valid = false.
    """
    turns = df.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(template.open), escaped(t["role"]), F.lit(template.named)), F.lit(False)),
                segment(escaped(t["text"]), t["role"].isin(*template.loss_roles)),
                segment(F.lit(template.close), F.lit(False)),
            ),
        )
    )

    def move(state, turn):
        cases = [(state == at) & (turn["role"] == role) for at, roles in template.moves.items() for role in roles]
        to = [nxt for roles in template.moves.values() for nxt in roles.values()]
        return F.coalesce(*(F.when(c, F.lit(n)) for c, n in zip(cases, to)), F.lit("invalid"))

    state = F.aggregate("turns", F.lit("start"), move)
    out = chats.select("conv_id", parts.alias("segments"), state.alias("state"))
    return out.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments", "state", F.col("state").isin(*template.final).alias("valid"))


def parse_chats(formatted, template: Template = Template()):
    """array<struct<role, text>> read back from a formatted string."""
    pieces = F.split(formatted, r"\Q" + template.close + r"\E")
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece):
        body = F.substring(piece, len(template.open) + 1, F.length(piece))
        mark = F.locate(template.named, body)
        return F.struct(unescaped(F.substring(body, F.lit(1), mark - 1)).alias("role"), unescaped(F.substring(body, mark + len(template.named), F.length(body))).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments):
    """The texts under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def op6_chat_format(spark, sf_dir):
    """Digests of the turns parsed from the formatted strings and of the segments under the loss mask."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    extra = extra.select(F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.lit(said).alias("text"))
    chats = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    read = chats.select("conv_id", "formatted", parse_chats(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("lossy"), "valid")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), "lossy", F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("lossy").cast("long").alias("loss_chars"), F.sha2("lossy", 256).alias("loss_sha256"), "formatted_chars", "valid")


QUERIES = {"op6_chat_format": op6_chat_format}
ORACLES = {
    "op6_chat_format": r"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, v.turn, v.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
    e AS (
      SELECT *, length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) + 15 AS chars,
        lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(chars) AS BIGINT) AS formatted_chars,
      bool_and((role = 'system' AND before = 'start') OR (role = 'user' AND before IN ('start', 'system', 'assistant')) OR (role = 'assistant' AND before = 'user')) AND max_by(role, k) = 'assistant' AS valid
    FROM e GROUP BY conv_id"""
}

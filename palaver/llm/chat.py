"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := HEAD turn*          HEAD is <chat:0> or <chat:1>
    turn         := <s> role \\n text </s>

A conversation is rendered as it is (<chat:0>) and parsed again; if it holds a
control string, or the turns that come back differ from the source (a role with
a line break), it is rendered with escapes (<chat:1>): & becomes &a, < becomes
&l, and a line break in a role &n.  No control string can then occur
inside a text, so the second rendering always parses to its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADS = ("<chat:0>", "<chat:1>")
OPEN, CLOSE = "<s>", "</s>"
CONTROL = "</?s>|<chat:[01]>"  # every control string
LEARNED = "assistant"  # the loss is taken on the texts of this role
ESCAPES = (("&", "&a"), ("<", "&l"), ("\n", "&n"))  # the last in roles only

C, L = F.col, F.lit


def _escape(text: Column, role: bool) -> Column:
    for plain, code in ESCAPES if role else ESCAPES[:2]:
        text = F.replace(text, L(plain), L(code))
    return text


def _unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):  # & last, so that no code appears anew
        text = F.replace(text, L(code), L(plain))
    return text


def render(turns: Column, level: int) -> Column:
    """The text of an array of (role, text), escaped at level 1."""

    def turn(t: Column) -> Column:
        role, text = (_escape(t.role, True), _escape(t.text, False)) if level else (t.role, t.text)
        return F.concat(L(OPEN), role, L("\n"), text, L(CLOSE))

    return F.concat(L(HEADS[level]), F.array_join(F.transform(turns, turn), ""))


def _pieces(formatted: Column) -> Column:
    """The turns between the control strings, still escaped."""
    found = F.split(F.substr(formatted, L(len(HEADS[0]) + 1)), CLOSE, -1)
    return F.slice(found, 1, F.size(found) - 1)


def _parts(piece: Column) -> tuple[Column, Column]:
    line = F.instr(piece, "\n")
    return F.substr(piece, L(len(OPEN) + 1), line - len(OPEN) - 1), F.substr(piece, line + 1)


def parse(formatted: Column) -> Column:
    """The (role, text) turns of a rendered conversation."""

    def turn(piece: Column) -> Column:
        role, text = _parts(piece)
        escaped = F.startswith(formatted, L(HEADS[1]))
        good = F.startswith(piece, L(OPEN)) & (F.instr(piece, "\n") > 0)
        return F.when(
            good,
            F.struct(F.when(escaped, _unescape(role)).otherwise(role).alias("role"), F.when(escaped, _unescape(text)).otherwise(text).alias("text")),
        )

    return F.transform(_pieces(formatted), turn)


def loss_runs(formatted: Column) -> Column:
    """The loss mask: runs of characters in order, (chars, loss), that cover the rendered text."""

    def runs(piece: Column, i: Column) -> Column:
        role, text = _parts(piece)
        head = F.when(i == 0, len(HEADS[0])).otherwise(0)
        run = lambda chars, loss: F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))
        return F.array(
            run(head + len(OPEN) + F.length(role) + 1, L(False)), run(F.length(text), role == LEARNED), run(L(len(CLOSE)), L(False))
        )

    return F.flatten(F.transform(_pieces(formatted), runs))


def learned(formatted: Column, runs: Column) -> Column:
    """The characters under the loss mask, unescaped, nothing between the runs.

    The mask has three runs a turn, of which the second ends where the turn is
    closed; so each turn's characters are cut from its own piece of the text.
    """

    def cut(piece: Column, i: Column) -> Column:
        run = F.get(runs, i * 3 + 1)
        text = F.right(piece, run.chars.cast("int"))
        return F.when(~run.loss, "").when(F.startswith(formatted, L(HEADS[1])), _unescape(text)).otherwise(text)

    return F.array_join(F.transform(_pieces(formatted), cut), "")


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, escaped, loss_runs, turns (read back), round_trip, for each conversation.

    ``rows`` has conv_id, turn, role and text.  A conversation is one string, so
    its own rows meet in one task; conversations are spread by conv_id.

    Defined cases: null texts and roles count as empty; turns are ordered by
    turn (null first), then role and text; repeated rows are turns each; a null
    conv_id is a conversation of its own; an empty table gives no rows; other
    columns are ignored.
    """
    own = rows.select(
        C("conv_id").cast("long").alias("conv_id"), C("turn").cast("long").alias("turn"),
        F.coalesce(C("role").cast("string"), L("")).alias("role"), F.coalesce(C("text").cast("string"), L("")).alias("text"),
    )
    chats = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    turns = F.transform("rows", lambda r: F.struct(r.role.alias("role"), r.text.alias("text")))
    plain = chats.select("conv_id", turns.alias("source")).withColumn("plain", render(C("source"), 0))
    held = F.exists("source", lambda t: F.regexp_like(t.role, L(CONTROL)) | F.regexp_like(t.text, L(CONTROL)))
    tried = plain.withColumn("escaped", held | ~F.coalesce(parse(C("plain")) == C("source"), L(False)))
    done = tried.withColumn("formatted", F.when(C("escaped"), render(C("source"), 1)).otherwise(C("plain")))
    back = done.withColumn("turns", parse(C("formatted")))
    return back.select("conv_id", "formatted", "escaped", loss_runs(C("formatted")).alias("loss_runs"), "turns", (C("turns") == C("source")).alias("round_trip"))


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted conversations give back: counts and digests of turns and of the text under the loss mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, L("\n"), t.text, L("\n"))), "")
    return chats.withColumn("learned", learned(C("formatted"), C("loss_runs"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "round_trip",
    )


SQL = """WITH rows AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
chats AS (
 SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
  bool_or(regexp_matches(role, '</?s>|<chat:[01]>') OR regexp_matches(text, '</?s>|<chat:[01]>') OR contains(role, chr(10))) AS escaped,
  sum(8 + length(role) + length(text)) AS plain,
  sum(length(role) - length(replace(replace(replace(role, '&', ''), '<', ''), chr(10), '')) + length(text) - length(replace(replace(text, '&', ''), '<', ''))) AS extra
 FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
 CAST(8 + plain + CASE WHEN escaped THEN extra ELSE 0 END AS BIGINT) AS formatted_chars, true AS round_trip
FROM chats"""

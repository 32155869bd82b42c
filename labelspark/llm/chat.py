"""Chat formatting from a declarative template, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of control strings and what stands for them inside texts. The backslash comes
#: first when escaping and last when undoing it; no escape holds another's character.
ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
#: Stands before a role that has no title, so that it is never read as one that has.
OTHER_ROLE = "\\o"


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are written and which role may follow which.

    A turn is `head`, the role's title, `colon`, the text and `end`. Texts of `learned` roles
    are under the loss. `follows` are the transitions of a finite-state machine whose states
    are the roles, "start" and "stop"; a conversation may stop after the roles of `stops`.
    """

    head: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    learned: tuple[str, ...] = ("assistant",)
    titles: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    follows: tuple[tuple[str, str], ...] = (
        ("start", "system"), ("start", "user"), ("system", "user"),
        ("user", "assistant"), ("assistant", "user"),
    )
    stops: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _title(role: Column, t: ChatTemplate) -> Column:
    out = F.concat(F.lit(OTHER_ROLE), escape(role))
    for name, title in t.titles:
        out = F.when(role == name, F.lit(title)).otherwise(out)
    return out


def _role(title: Column, t: ChatTemplate) -> Column:
    out = unescape(F.substr(title, F.lit(len(OTHER_ROLE) + 1)))
    for name, known in t.titles:
        out = F.when(title == known, F.lit(name)).otherwise(out)
    return out


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Format conversations (conv_id, turn, role, text), one row each.

    Returns conv_id, segments (array of text and loss, in order), formatted (all segments'
    texts), valid_order and first_bad_turn (place of the first turn that the state machine
    rejects, from 0; -1 if none). Conversations out of order are formatted too.

    Turns are ordered by turn (null first), then role and text; repeated rows are turns of
    their own. Null roles and texts are empty; rows with a null conv_id are one conversation.
    Further columns are ignored; an empty table gives an empty result. A conversation is one
    value of the output, so its turns come together in one row.
    """
    t = template
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    gathered = (
        turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    parts = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                _segment(F.concat(F.lit(t.head), _title(x["role"], t), F.lit(t.colon)), F.lit(False)),
                _segment(escape(x["text"]), x["role"].isin(*t.learned)),
                _segment(F.lit(t.end), F.lit(False)),
            ),
        )
    )
    edges = F.array(*[F.lit(f"{a}\n{b}") for a, b in t.follows])
    steps = F.concat(F.array(F.lit("start")), F.transform("turns", lambda x: x["role"]))
    bad = F.array_position(
        F.transform(
            F.sequence(F.lit(0), F.size("turns") - 1),
            lambda i: F.array_contains(edges, F.concat(steps[i], F.lit("\n"), steps[i + 1])),
        ),
        F.lit(False),
    )
    stopped = F.element_at("turns", -1)["role"].isin(*t.stops)
    made = gathered.select(
        "conv_id", parts.alias("segments"), bad.alias("bad"), stopped.alias("stopped")
    )
    return made.select(
        "conv_id", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        ((F.col("bad") == 0) & F.col("stopped")).alias("valid_order"),
        (F.col("bad") - 1).cast("int").alias("first_bad_turn"),
    )


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, turns (array of role and text) and learned (all text under the loss).

    Turns are cut out of the formatted text, the learned text out of the segments.
    """
    t = template
    pieces = F.split("formatted", f"\\Q{t.end}\\E", -1)
    turns = F.transform(
        F.filter(pieces, lambda p: p != ""),
        lambda p: F.struct(
            _role(F.substring_index(F.substr(p, F.lit(len(t.head) + 1)), t.colon, 1), t).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, t.colon, 1)) + len(t.colon) + 1)).alias("text"),
        ),
    )
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.select("*", turns.alias("turns"), learned.alias("learned"))


def chat_digests(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """What is read back from the formatted conversations, as sizes and digests."""
    back = read_back(format_chats(turns, template), template)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid_order", "first_bad_turn",
    )


#: A conversation whose texts hold the template's own control strings.
ODD_CONVERSATION = [
    (-7, 0, "user", "\\### Assistant: </turn> ok"),
    (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
]


def with_odd_conversation(turns: DataFrame) -> DataFrame:
    odd = turns.sparkSession.createDataFrame(ODD_CONVERSATION, "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(odd)

"""Chat texts from event logs, in DataFrame functions only.

A log holds the events of streamed messages: ``delta`` adds text to a message, ``edit`` replaces what it
held, ``regenerate`` throws it away. Events are sorted by sequence and folded into messages, one
message at a time, so a long conversation is folded by many tasks; only the final turns of a
conversation meet in one row, since its formatted text is one value.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts ``&`` becomes
``&amp;`` and ``<|`` becomes ``&lt;|``, so control strings only ever come from the template; a line
feed in a role becomes ``&#10;``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import pick

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def event_log(conversations: DataFrame, piece: int = 256) -> DataFrame:
    """The log a chat server would have kept of finished conversations (``conv_id, turn, role, text``).

    ``conv_id, message, turn, role, seq, kind, text``: assistant messages are a draft, a regeneration
    and deltas of ``piece`` characters; other messages are a first delta and an edit to the whole text.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.monotonically_increasing_id().alias("message"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def event(seq, kind, text):
        return F.struct(
            F.lit(seq).alias("seq") if isinstance(seq, int) else seq.alias("seq"),
            F.lit(kind).alias("kind"),
            text.alias("text"),
        )

    draft = F.substring("text", 1, 32)
    last = F.floor((F.length("text") - 1) / piece).cast("int")
    deltas = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: event(i + 2, "delta", F.substring(F.col("text"), i * piece + 1, F.lit(piece))),
    )
    streamed = F.concat(
        F.array(event(0, "delta", draft), event(1, "regenerate", F.lit(""))), deltas
    )
    edited = F.array(event(0, "delta", draft), event(1, "edit", F.col("text")))
    events = F.when(F.col("role") == TRAINED_ROLE, streamed).otherwise(edited)
    return rows.select("conv_id", "message", "turn", "role", F.explode(events).alias("e")).select(
        "conv_id", "message", "turn", "role", "e.seq", "e.kind", "e.text"
    )


def fold(log: DataFrame) -> DataFrame:
    """The final ``conv_id, turn, role, text, message`` of each message of a log.

    Null texts, kinds and roles count as empty, and kinds other than the three add nothing. Of repeated
    sequence numbers the order is by kind and text.
    """
    log = pick(log, "conv_id", "message", "turn", "role", "seq", "kind", "text")
    events = F.sort_array(
        F.collect_list(
            F.struct(
                "seq",
                F.coalesce("kind", F.lit("")).alias("kind"),
                F.coalesce("text", F.lit("")).alias("text"),
            )
        )
    )
    # turn and role are the same on all events of a message; max skips nulls
    messages = log.groupBy("conv_id", "message").agg(
        events.alias("events"),
        F.max("turn").alias("turn"),
        F.coalesce(F.max("role"), F.lit("")).alias("role"),
    )
    resets = F.transform(
        "events", lambda e, i: F.when(e.kind.isin("edit", "regenerate"), i).otherwise(F.lit(-1))
    )
    start = F.greatest(F.array_max(resets), F.lit(0))
    live = F.filter(
        "events",
        lambda e, i: (i >= F.col("start")) & e.kind.isin("delta", "edit"),
    )
    return messages.withColumn("start", start).select(
        "conv_id", "turn", "role", F.array_join(F.transform(live, lambda e: e.text), "").alias("text"), "message"
    )


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, segments``: the text of each conversation and its pieces.

    ``segments`` holds ``(text, loss)``; their texts in order are ``formatted``, and ``loss`` marks the
    assistant's words. Turns are ordered by turn (null first), then role, text and message.
    """
    turn = F.struct("turn", "role", "text", "message")
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segment(text, loss):
        return F.struct(text.alias("text"), loss.alias("loss"))

    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(START), escape_role(t.role), F.lit("\n")), F.lit(False)),
                segment(escape(t.text), t.role == TRAINED_ROLE),
                segment(F.lit(END + "\n"), F.lit(False)),
            ),
        )
    )
    return turns.select("conv_id", pieces.alias("segments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What a formatted table says: its turns and its trained text, unescaped, as digests."""
    parts = F.split("formatted", r"<\|im_start\|>")  # nothing stands before the first mark
    marked = F.slice(parts, F.lit(2), F.size(parts))

    def turn(p):
        head = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(head) + 2, F.length(p) - F.length(head) - len(END) - 2)
        return F.concat(unescape_role(head), F.lit("\n"), unescape(body), F.lit("\n"))

    trained = F.array_join(
        F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text)), ""
    )
    read = formatted.select(
        "conv_id",
        F.size(marked).cast("long").alias("n_turns"),
        F.array_join(F.transform(marked, turn), "").alias("turns"),
        trained.alias("trained"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def format_chats(log: DataFrame) -> DataFrame:
    """``conv_id, formatted, segments`` from an event log; an empty log gives no rows."""
    return render(fold(log))

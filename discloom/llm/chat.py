"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of conversations: `message` starts a message, `delta` appends to it, `edit` and `regenerate`
replace what it says, `delete` removes it. Events of a message are sorted by sequence and folded: text from the
last event that replaces, then the deltas after it. Messages stand in the order of their first events and are
rendered as

    <|turn|>ROLE<|text|>TEXT<|end|>

one after another. Inside roles and texts a backslash becomes two and `<|` becomes `<\\|`, so no text can hold a
control string and reading back is exact. The loss mask holds the character ranges of assistant texts.

Plan: grouping by (conversation, message) comes first where the log names messages, so a long stream of deltas
is folded in parallel; then one grouping by conversation, whose rendered row is the result anyway.

Edge cases: null role or text counts as empty; null sequences come first; ties in sequence are ordered by role
and text, and each row without a message id is a message of its own, repeated rows included; a null conversation
is a conversation. Unknown operations count as `message`. Extra columns are not looked at; an empty log gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Characters of the draft that as_events() starts a message with.
DRAFT = 12


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def fold_events(log: DataFrame, conv: str, seq: str, role: str, text: str, message: str, op: str | None) -> DataFrame:
    """One row for each message that is left: conversation, sequence of its first event, role, final text."""
    done = F.coalesce(F.col(op), F.lit("message")) if op else F.lit("message")
    event = F.struct(F.col(seq).alias("seq"), done.alias("op"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    events = F.array_sort(F.collect_list(event))
    grouped = log.groupBy(F.col(conv).alias("conv"), F.col(message).alias("message")).agg(events.alias("e"))
    # where the last event stands that is not a delta: the final text starts there
    from_end = F.array_position(F.transform(F.reverse("e"), lambda x: x["op"] != "delta"), True).cast("int")
    grouped = grouped.withColumn("at", F.when(from_end > 0, F.size("e") - from_end + 1).otherwise(1))
    final = F.slice("e", F.col("at"), F.size("e"))
    named = F.filter("e", lambda x: x["role"] != "")
    return grouped.where(F.element_at("e", F.col("at"))["op"] != "delete").select(
        F.col("conv").alias(conv), F.col("e")[0]["seq"].alias(seq), F.when(F.size(named) > 0, F.element_at(named, 1)["role"]).otherwise("").alias(role),
        F.array_join(F.transform(final, lambda x: x["text"]), "").alias(text),
    )


def as_events(log: DataFrame, conv: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A log of whole messages as the events that a stream of them would leave: conv, message, seq, role, text, op.

    Each row starts as a draft of its first DRAFT characters, is regenerated as its first half and ends with a delta of the rest.
    seq is (the row's sequence, the event's number), so a null sequence keeps its events in order.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    half = F.floor(F.length(whole) / 2).cast("int")
    event = lambda n, op, part: F.struct(F.lit(n).alias("n"), F.lit(op).alias("op"), part.alias("text"))
    events = F.array(event(0, "message", F.substr(whole, F.lit(1), F.lit(DRAFT))), event(1, "regenerate", F.substr(whole, F.lit(1), half)), event(2, "delta", F.substr(whole, half + 1)))
    # numbered before the explode, so that a row's events have one number
    rows = log.select(F.col(conv).alias(conv), F.monotonically_increasing_id().alias("message"), F.col(seq).alias("turn"), F.col(role).alias("role"), events.alias("events"))
    rows = rows.select(conv, "message", "turn", "role", F.explode("events").alias("e"))
    return rows.select(conv, "message", F.struct("turn", "e.n").alias("seq"), "role", "e.text", "e.op")


def format_chats(log: DataFrame, conv: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text", message: str | None = None, op: str | None = None) -> DataFrame:
    """conv, formatted, loss_spans (array of start and end, in characters): one row for each conversation."""
    own = log
    if message is not None:
        own = fold_events(log.where(F.col(message).isNotNull()), conv, seq, role, text, message, op)
        loose = log.where(F.col(message).isNull()).select(conv, F.col(seq), role, text)
        own = own.unionByName(loose)
    rows = own.select(F.col(conv).alias("conv"), F.col(seq).alias("seq"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"head": F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)), "body": escape(F.col("text"))})
    order = Window.partitionBy("conv").orderBy("seq", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stop", F.sum(F.length("head") + F.length("body") + F.lit(len(END)).cast("long")).over(order))
    turns = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("stop", "role", "head", "body"))).alias("t"))
    body = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    spans = F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: F.struct((x["stop"] - len(END) - F.length(x["body"])).alias("start"), (x["stop"] - len(END)).alias("end")))
    return turns.select(F.col("conv").alias(conv), body.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    parts = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
        unescape(F.substr(x, F.locate(TEXT, x) + F.lit(len(TEXT)))).alias("text"),
    ))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))


def digest(formats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What can be read back from the output of format_chats()."""
    turns = read_turns(F.col("formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formats.withColumn("turns", turns).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Rows that the query adds: texts that hold control strings of other templates and a backslash.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

ORACLE = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped as (
  select *, replace(replace(role, '\', '\\'), '<|', '<\|') as r, replace(replace(text, '\', '\\'), '<|', '<\|') as t from rows
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(r) + length(t) + 23)::bigint as formatted_chars
from escaped group by conv_id
"""

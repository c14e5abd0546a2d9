"""Chat formatting from event logs, with DataFrame functions only.

A log has events on messages of conversations: ``start`` opens a message, ``delta`` appends to it, ``edit`` puts a text in the
place of what it said, and ``regenerate`` begins a message anew and drops every later message that was there before.
``fold`` turns the log into final messages.  An event is dead if a message further up was regenerated after it; the
latest such moment is a running maximum over a conversation's messages, taken over ranges of messages first, so that a conversation
of any size is spread over tasks.  The moments join the log as events of their own, and one shuffle by message folds it.

``render`` gives a row for each message, marked and with control strings escaped, and the place of what is learned
from; a conversation's text is its rows one after another.  ``read_back`` undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

OPEN, CLOSE = "<turn ", "\n</turn>\n"
#: What the escape character is put before: itself, and the beginnings of marks.
CONTROL, ESCAPED = r"(\\|</?turn)", r"\\([\\<])"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1")


def moments(events: DataFrame) -> DataFrame:
    """conv, message, seq: events of the message up to ``seq`` are dead, as one before it was regenerated then.

    Messages are dealt into ranges; what lies before a range is one row for each range."""
    heads = events.groupBy("conv", "message").agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("seq"))
    placed = cut(heads.repartitionByRange("conv", "message").withColumn("range", F.spark_partition_id()), "chat-heads")
    ranges = placed.groupBy("conv", "range").agg(F.max("seq").alias("seq"))
    earlier = F.max("seq").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    before = ranges.withColumn("seq", earlier).filter("seq is not null").select("conv", "range", F.lit(0).alias("own"), F.lit(None).cast(placed.schema["message"].dataType).alias("message"), "seq")
    rows = placed.select("conv", "range", F.lit(1).alias("own"), "message", "seq").unionByName(before)
    within = F.max("seq").over(Window.partitionBy("conv", "range").orderBy("own", "message").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("seq", within).filter("own = 1 and seq is not null").select("conv", "message", "seq")


def fold(log: DataFrame, conv_col: str = "conv_id", message_col: str = "message", seq_col: str = "seq", kind_col: str = "kind", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The final messages of a log: conversation, ``message``, ``role``, ``text``.

    Messages and moments (``seq``) are of any type that has an order; a moment orders the events of its conversation.  A message's
    text begins at its last start, edit or regeneration and takes in the deltas after it.  Its role is that of the last living
    event that names one, else empty.  Events of one message at one moment go in the order of kind and text.  Null texts are empty,
    null conversations and messages count as ones of their own, events of unknown or null kinds are passed over, and an empty log
    gives no rows.  A message's events meet in one task, as its text is one value; a conversation's need not.
    """
    events = log.select(F.col(conv_col).alias("conv"), F.col(message_col).alias("message"), F.col(seq_col).alias("seq"), F.col(kind_col).alias("kind"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    events = events.filter(F.col("kind").isin("start", "delta", "edit", "regenerate"))
    dead = moments(events).select("conv", "message", "seq", F.lit("dead").alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    grouped = events.unionByName(dead).groupBy("conv", "message").agg(F.collect_list(F.when(F.col("kind") != "dead", event)).alias("events"), F.max(F.when(F.col("kind") == "dead", F.col("seq"))).alias("dead"))
    living = grouped.withColumn("events", F.sort_array(F.filter("events", lambda e: F.col("dead").isNull() | (e["seq"] > F.col("dead"))))).filter(F.size("events") > 0)
    begin = F.array_max(F.transform("events", lambda e, i: F.when(e["kind"] != "delta", i)))
    living = living.withColumn("begin", F.coalesce(begin, F.lit(0)))
    roles = F.filter("events", lambda e: e["role"].isNotNull())
    text = F.array_join(F.transform(F.slice("events", F.col("begin") + 1, F.size("events")), lambda e: e["text"]), "")
    return living.select(F.col("conv").alias(conv_col), "message", F.coalesce(F.get(roles, F.size(roles) - 1)["role"], F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, conv_col: str = "conv_id", learned: str = LEARNED) -> DataFrame:
    """Conversation, ``message``, ``formatted``, and of messages by ``learned`` the place of the text under the loss mask,
    ``loss_start`` and ``loss_chars`` (code points within ``formatted``; null for the rest).  Roles are URL-encoded."""
    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit(">\n"))
    rows = messages.select(conv_col, "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    mine = F.col("role") == learned
    return rows.select(
        conv_col, "message", F.concat("head", "body", F.lit(CLOSE)).alias("formatted"),
        F.when(mine, F.char_length("head")).cast("bigint").alias("loss_start"), F.when(mine, F.char_length("body")).cast("bigint").alias("loss_chars"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, be it one message or a whole conversation.

    An escaped text has no mark in it, so what lies between marks is one turn; a head has no line break in it."""
    turns = F.split(formatted, CLOSE, -1)
    head = lambda t: F.substring_index(t, "\n", 1)
    role = lambda t: F.url_decode(F.substring(head(t), F.lit(len(OPEN) + 1), F.char_length(head(t)) - len(OPEN) - 1))
    text = lambda t: unescape(F.substring(t, F.char_length(head(t)) + 2, F.char_length(t)))
    return F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: F.struct(role(t).alias("role"), text(t).alias("text")))


def as_log(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A log whose folding gives the table's turns: every text comes in pieces.  What is not the assistant's is edited half-way; the
    assistant's is drafted, answered by a stray message, and regenerated, which drops both.

    Turns of one number go by role and then by md5 of the text; repeated rows are turns of their own.  Null roles and texts are empty."""
    clean = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    key = F.struct("turn", "role", F.unhex(F.md5("text")).alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = clean.select("conv_id", key.alias("at"), "role", "text", F.ceil(F.char_length("text") / 4).cast("int").alias("quarter"))
    piece = lambda k, n=1: F.substring("text", F.col("quarter") * k + 1, F.col("quarter") * n)
    event = lambda step, kind, text, stray=0: F.struct(F.lit(step).alias("step"), F.lit(stray).alias("stray"), F.lit(kind).alias("kind"), text.alias("text"))
    draft = [event(0, "start", F.lit("")), event(1, "delta", piece(0)), event(2, "start", F.lit("stray"), 1), event(3, "regenerate", piece(0)), *[event(3 + k, "delta", piece(k)) for k in (1, 2, 3)]]
    typed = [event(0, "start", piece(1)), event(1, "edit", piece(0, 2)), event(2, "delta", piece(2)), event(3, "delta", piece(3))]
    steps = rows.select("conv_id", "at", "role", F.explode(F.when(F.col("role") == LEARNED, F.array(*draft)).otherwise(F.array(*typed))).alias("e"))
    return steps.select("conv_id", F.struct("at", "e.stray").alias("message"), F.struct("at", "e.step").alias("seq"), "e.kind", "role", "e.text")


def digest(rendered: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What is read back from formatted rows, per conversation.  A SHA-256 runs over a text from its begin to its end, so a conversation's
    texts are put together in one row here, and here only."""
    spans = F.substring("formatted", F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int"))
    rows = rendered.select(conv_col, "message", F.char_length("formatted").alias("chars"), read_back(F.col("formatted")).alias("turns"), F.coalesce(unescape(spans), F.lit("")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select(conv_col, "chars", F.size("turns").alias("n"), F.struct("message", said.alias("said"), "loss").alias("row"))
    whole = rows.groupBy(conv_col).agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("row")).alias("rows"))
    loss = F.array_join(F.transform("rows", lambda r: r["loss"]), "")
    whole = whole.select(conv_col, "n_turns", "formatted_chars", F.array_join(F.transform("rows", lambda r: r["said"]), "").alias("said"), loss.alias("loss"))
    return whole.select(conv_col, "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the escape character and a mark."""
    role = F.when(F.col("id") == 0, "user").otherwise(LEARNED)
    return spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formatted messages of a table of turns: written, and read again from the shared folder."""
    log = cut(as_log(conversations), "chat-log")
    return cut(render(fold(log)), "chat-formatted")

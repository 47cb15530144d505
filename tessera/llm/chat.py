"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

The log holds events of conversations: ``message`` opens a message of a turn,
``delta`` appends to it, ``edit`` replaces its text, ``regenerate`` empties it (deltas
that follow fill it again) and makes the later turns that were opened before it void.  Nothing brings
a void message back: its further events, regenerations too, count for nothing.  Events are
hashed by (conversation, turn), folded there in order of their sequence numbers, and
only whole messages move on to their conversation, where the template renders them.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per message.  Inside texts and
roles every ``<``, k backslashes, ``|`` gets one backslash more, so no control string
can occur there, and reading back takes one away.  Newlines and backslashes of a role
are escaped as ``\\n`` and ``\\\\`` first.

Defined cases: null text or role is empty; a null conv_id is a conversation of its
own; a null turn comes first; rows that repeat a turn are messages of their own, in
order of role, then text; events of a turn before its first message (orphans) count for nothing; of events with one
sequence number messages come first, then the others by event, role and text; a null sequence number comes before
all; a conversation without messages has no row; an empty log gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    pieces = F.split(unescape(role), r"\\\\")  # at doubled backslashes, from the left
    return F.array_join(F.transform(pieces, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def reconstruct(events: DataFrame) -> DataFrame:
    """events(conv_id, seq, event, turn, role, text) -> final messages(conv_id, turn, msg, role, text)."""
    rows = events.select("conv_id", "seq", "event", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_turn = Window.partitionBy("conv_id", "turn").orderBy("seq", F.col("event") != "message", "event", "role", "text")
    of_msg = Window.partitionBy("conv_id", "turn", "msg")
    rows = rows.withColumn("rn", F.row_number().over(by_turn)).withColumn("msg", F.sum((F.col("event") == "message").cast("int")).over(by_turn.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter("msg > 0").withColumn("reset", F.max(F.when(F.col("event") != "delta", F.col("rn"))).over(of_msg))
    return rows.groupBy("conv_id", "turn", "msg").agg(
        F.min_by("role", "rn").alias("role"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when((F.col("rn") >= F.col("reset")) & (F.col("event") != "regenerate"), F.struct("rn", "text")))),
                lambda x: x["text"],
            ),
            "",
        ).alias("text"),
        F.min(F.when(F.col("event") == "message", F.col("seq"))).alias("opened"),
        F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).alias("regenerated"),
    )


def gather(messages: DataFrame) -> DataFrame:
    """conv_id, ms: each conversation's messages in order, without the void ones.

    A message is void if it was opened before the last regeneration of an earlier message that isn't void itself.
    """
    parts = F.struct("turn", "msg", "role", "text", "opened", "regenerated")
    rows = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(parts)).alias("ms"))
    flags = """
        aggregate(transform(ms, m -> struct(m.opened AS opened, m.regenerated AS regenerated)), struct(cast(null AS bigint) AS last, '' AS kept), (s, m) ->
            IF(m.opened < s.last, struct(s.last AS last, s.kept || '0' AS kept), struct(greatest(s.last, m.regenerated) AS last, s.kept || '1' AS kept))).kept
    """
    some = F.expr("exists(ms, m -> m.regenerated IS NOT NULL)")
    kept = F.expr(f"transform(filter(arrays_zip(ms, split({flags}, '')), z -> z.`1` = '1'), z -> z.ms)")
    return rows.select("conv_id", F.when(some, kept).otherwise(F.col("ms")).alias("ms"))


def render(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (code points of the formatted text, end exclusive)."""
    head = lambda m: F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n"))
    shown = F.transform("ms", lambda m: F.struct(m["role"].alias("role"), head(m).alias("head"), escape(m["text"]).alias("body")))
    whole = F.array_join(F.transform("shown", lambda m: F.concat(m["head"], m["body"], F.lit(END + "\n"))), "")
    # places: of each message the end of its body, the sum of what is up to there
    lengths = F.transform("shown", lambda m: F.struct((m["role"] == loss_role).alias("loss"), F.length(m["head"]).cast("long").alias("head"), F.length(m["body"]).cast("long").alias("body")))
    places = F.expr(
        f"""
        aggregate(lengths, struct(0L AS at, cast(array() AS array<struct<start: bigint, end: bigint>>) AS spans), (s, m) -> struct(
            s.at + m.head + m.body + {len(END) + 1} AS at,
            IF(m.loss, array_append(s.spans, struct(s.at + m.head AS start, s.at + m.head + m.body AS end)), s.spans) AS spans)).spans
        """
    )
    rows = conversations.select("conv_id", shown.alias("shown")).select("conv_id", whole.alias("formatted"), lengths.alias("lengths"))
    return rows.select("conv_id", "formatted", places.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    tail = len(END + "\n")
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(F.substring_index(x, "\n", 1)) - 1 - tail)).alias("text"),
        ),
    )


def format_chats(events: DataFrame) -> DataFrame:
    return render(gather(reconstruct(events)))


def as_events(conversations: DataFrame, piece: int = 512) -> DataFrame:
    """A finished conversation table as the log that streaming it would have left: each row opens an empty message, which deltas of at most so many code points fill.

    Sequence numbers order the events of a turn; rows that repeat a turn follow each other by role, then text.
    """
    again = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("first", (F.row_number().over(again) - 1).cast("long") * (1 << 32))
    rows = rows.select("conv_id", "turn", "role", "first", F.posexplode(F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)))).alias("k", "text"))
    return rows.select("conv_id", (F.col("first") + F.col("k")).alias("seq"), F.when(F.col("k") == 0, "message").otherwise("delta").alias("event"), "turn", "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """The columns of the contract, all read back from the formatted text."""
    read = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("ts"))
    turns = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("ts", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return read.withColumn("loss", loss).select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose two texts are made of control strings."""
    text = f"{END}{START}assistant ok"
    row = lambda turn, role: f"SELECT cast(-1 AS bigint) AS conv_id, cast({turn} AS bigint) AS turn, '{role}' AS role, '{text}' AS text"
    return spark.sql(f"{row(0, 'user')} UNION ALL {row(1, 'assistant')}")

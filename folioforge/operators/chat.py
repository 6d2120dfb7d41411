"""Chat messages: content to text, the question of a conversation, its validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, strip

#: Longest question, in characters.
MAX_QUESTION = 12_000


def content_text(content: Column | str) -> Column:
    """Text of a message's content in JSON: a string, or a list of strings and of objects with text or content, blank ones dropped."""
    c = col(content)
    parts = F.from_json(c, "array<string>")
    one = lambda x: F.coalesce(F.when(F.get_json_object(x, "$.text") != "", F.get_json_object(x, "$.text")), F.get_json_object(x, "$.content"), F.when(~x.startswith("{"), x), F.lit(""))
    joined = F.array_join(F.filter(F.transform(parts, one), lambda x: strip(x) != ""), "\n")
    quoted = F.from_json(F.concat(F.lit('{"x":'), c, F.lit("}")), "x string")["x"]
    return F.when(c.rlike(r"^\s*\["), joined).when(c.rlike(r'^\s*"'), quoted).otherwise(c)


def last_user_message(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "msg_role", text: str = "text") -> DataFrame:
    """The last user message of each conversation, stripped: conv_id, turn, question. Conversations without one have no row; of equal turns the greatest text."""
    last = messages.where(F.col(role) == "user").groupBy(F.col(conv).alias("conv_id")).agg(F.max(F.struct(F.col(turn).alias("turn"), F.coalesce(text, F.lit("")).alias("t"))).alias("m"))
    return last.select("conv_id", F.col("m.turn").alias("turn"), strip("m.t").alias("question"))


def question_status(question: Column | str, most: int = MAX_QUESTION) -> Column:
    """`empty` for null and blank questions, `too_long`, or `ok`."""
    q = strip(F.coalesce(col(question), F.lit("")))
    return F.when(q == "", F.lit("empty")).when(F.length(q) > most, F.lit("too_long")).otherwise(F.lit("ok"))


def ends_with_assistant(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "msg_role") -> DataFrame:
    """Conversations whose last message is from the assistant: conv_id, turn."""
    last = messages.groupBy(F.col(conv).alias("conv_id")).agg(F.max_by(role, turn).alias("r"), F.max(turn).alias("turn"))
    return last.where("r = 'assistant'").select("conv_id", "turn")

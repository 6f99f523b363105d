"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context and only its text is trainable.
A turn is written as `[INST]role[/INST]text</s>`. A control string inside a role or a text gets a backslash after its first
character, one more than it had, so formatted text holds control strings only where the template put them and the
escape can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
_CONTROL = r"([\[<])(\\*)(/?INST\]|/s>)"
_ESCAPED = r"([\[<])\\(\\*)(/?INST\]|/s>)"


def escape(text: Column) -> Column:
    """text without control strings."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """What escape was given."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the turns of each conversation as (turn, role, text), by turn, null first, then role and text; null roles and texts are empty."""
    turn = F.struct(F.col("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def examples(conversations: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """conv_id, target, formatted, loss_start, loss_chars, last: an example for each turn of the trainable role.

    formatted holds the turns up to the target (from 1) and ends with it; the loss_chars code points after the first loss_start are under the loss mask.
    last marks the example that ends its conversation. Turns after the last trainable one come in a record of their own with
    all turns as context and an empty mask, so that no turn is lost.

    Rows with a null conv_id form one conversation, repeated rows are turns of their own, an empty table gives no row, other
    columns aren't read. An example is one row, so a conversation has to fit one; examples are made one at a time.
    """
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trainable_role).alias("own")))
    rows = turn_rows(conversations).select("conv_id", parts.alias("parts"))
    size = F.size("parts")
    targets = F.filter(F.sequence(F.lit(1), size), lambda k: (k == size) | F.element_at("parts", k)["own"])
    each = rows.select("conv_id", "parts", F.explode(targets).alias("target"))
    ends = F.element_at("parts", F.col("target"))
    context = F.array_join(F.transform(F.slice("parts", 1, F.col("target") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    each = each.select("conv_id", "target", F.concat(context, ends["head"]).alias("context"), ends["body"].alias("body"), ends["own"].alias("own"), (F.col("target") == size).alias("last"))
    return each.select(
        "conv_id", "target", F.concat("context", "body", F.lit(END)).alias("formatted"),
        F.char_length("context").alias("loss_start"), F.when(F.col("own"), F.char_length("body")).otherwise(0).alias("loss_chars"), "last",
    )


def parsed_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    turns = F.split(formatted, END, -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)
    at = lambda t: F.instr(t, CLOSE)
    return F.transform(turns, lambda t: F.struct(unescape(F.substring(t, F.lit(len(OPEN) + 1), at(t) - len(OPEN) - 1)).alias("role"), unescape(F.substring(t, at(t) + len(CLOSE), F.char_length(t))).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples of examples(), from the formatted texts and their masks."""
    turns = parsed_turns(F.col("formatted"))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = formatted.select(
        "conv_id", "target", unescape(F.expr("substring(formatted, loss_start + 1, loss_chars)")).alias("loss"), F.char_length("formatted").cast("bigint").alias("chars"),
        F.when(F.col("last"), F.struct(F.size(turns).cast("bigint").alias("n"), F.sha2(text, 256).alias("sha"))).alias("turns"),
    )
    each = rows.groupBy("conv_id").agg(F.max("turns").alias("turns"), F.sort_array(F.collect_list(F.struct("target", "loss"))).alias("loss"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    loss = F.array_join(F.col("loss.loss"), "")
    return each.select("conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"), F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_examples")

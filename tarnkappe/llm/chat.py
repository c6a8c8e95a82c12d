"""Chat formatting with prefix-target expansion (operator 4; DataFrame operations only).

Every assistant turn becomes an example: all turns before it as context, and only its own text trainable. The template
writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles a backslash is doubled and one is put
behind each ``<`` and ``[``, so no control string of this or another template can stand there; taking these away gives
the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkappe.session import new_folder

START, END = "<|im_start|>", "<|im_end|>\n"
EXAMPLES = "conv_id long, example int, text string, loss_start int, loss_length int"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _replace(_replace(_replace(text, "\\", "\\\\"), "<", "<\\"), "[", "[\\")


def unescape(text: Column) -> Column:
    return _replace(_replace(_replace(text, "<\\", "<"), "[\\", "["), "\\\\", "\\")


def escape_role(role: Column) -> Column:
    """A role ends with its line, so a line feed in it becomes ``<n``."""
    return _replace(escape(role), "\n", "<n")


def unescape_role(role: Column) -> Column:
    return unescape(_replace(role, "<n", "\n"))


def expand(turns: DataFrame) -> DataFrame:
    """Examples of all conversations; ``turns`` has conv_id, turn, role, text.

    ``loss_start`` and ``loss_length`` are the trainable span of ``text`` in code points, ``example`` counts the turns
    that it holds. A conversation that doesn't end with an assistant turn gets one more example, with all turns and no
    trainable span, so nothing is lost. Null texts and roles are empty, null turns come first, equal turn numbers are
    ordered by role and text, repeated rows are turns of their own, rows without conv_id are one conversation, other
    columns are ignored; an empty table gives no examples. A conversation is the unit of work: the context of its last
    turn is all of it.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).withColumn("n", F.size("turns"))
    shown = F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END)))
    last = F.array(F.struct(F.col("n").alias("example"), F.lit(None).cast("string").alias("reply")))
    replies = F.filter(
        F.transform("turns", lambda t, i: F.struct((i + 1).alias("example"), F.when(t["role"] == "assistant", escape(t["text"])).alias("reply"))),
        lambda e: e["reply"].isNotNull(),
    )
    open_end = F.element_at("turns", -1)["role"] != "assistant"
    examples = whole.select("conv_id", shown.alias("shown"), F.explode(F.when(open_end, F.concat(replies, last)).otherwise(replies)).alias("e"))
    reply = F.col("e.reply")
    context = F.array_join(F.slice("shown", 1, F.when(reply.isNull(), F.col("e.example")).otherwise(F.col("e.example") - 1)), "")
    head = F.lit(f"{START}assistant\n")
    text = F.when(reply.isNull(), F.col("context")).otherwise(F.concat("context", head, reply, F.lit(END)))
    start = F.when(reply.isNull(), 0).otherwise(F.char_length("context") + F.char_length(head))
    return examples.withColumn("context", context).select("conv_id", F.col("e.example").alias("example"), text.alias("text"), start.alias("loss_start"), F.coalesce(F.char_length(reply), F.lit(0)).alias("loss_length"))


def read_back(examples: DataFrame) -> DataFrame:
    """Turns and trainable texts of each conversation from its examples: conv_id, turns, replies, formatted_chars."""
    reply = F.struct("example", unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_length"))).alias("text"))
    whole = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("loss_start") > 0, reply))).alias("replies"),
        F.sum(F.char_length("text")).alias("formatted_chars"),
    )
    lines = F.filter(F.split("whole", r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(START) + 1)), "\n", 1)
        text = F.substr(piece, F.char_length(role) + len(START) + 2)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return whole.select("conv_id", F.transform(lines, turn).alias("turns"), F.transform("replies", lambda r: r["text"]).alias("replies"), "formatted_chars")


def chat_query(spark: SparkSession, turns: DataFrame) -> DataFrame:
    saying = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), saying.alias("text"))
    path = new_folder(spark, "chat")
    expand(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)).write.parquet(path)
    back = read_back(spark.read.schema(EXAMPLES).parquet(path))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("replies", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )

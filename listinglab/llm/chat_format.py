"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, its own text as the
only trainable span. The template writes a turn as

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

Control strings (these and those of other common templates) inside roles and texts get a
backslash after their first character; those that hold backslashes there already get one
more. So no control string is left in a text, and taking one backslash away gives it back.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# What may follow `<` or `[` in a control string.
_TAILS = r"(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*" + _TAILS + ")", r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*" + _TAILS + ")", "$1$2")


def expand_prefix_targets(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Examples of `turns` (conv_id, turn, role, text; more columns are left out).

    Returns conv_id, example (from 1), target_turn (1-based place of the trained turn, null
    for a tail), formatted, loss_start and loss_len (code points of `formatted`; the span
    covers the escaped text of the last turn).

    A conversation whose last turn is not trainable gets one more example, the tail, with an
    empty span: so the output holds every turn. Turns stand by `turn` (null first), ties by
    role, then text; repeated rows stay. Null roles and texts are empty, a null conv_id is a
    conversation like others. No rows give no examples.

    The growing window frame hands on one prefix after the other: a task holds one example at
    a time, never all those of a long conversation. The output's size is the square of a
    conversation's turns by definition.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("body", escape(F.col("text"))).withColumn("block", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP), "body", F.lit(END)))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    trained = F.col("role") == target_role
    t = t.select(
        "conv_id",
        F.row_number().over(w).alias("place"),
        trained.alias("trained"),
        F.length("body").alias("body_len"),
        F.lead(F.lit(1)).over(w).isNull().alias("last"),
        F.collect_list("block").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("blocks"),
        F.count_if(trained).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("seen"),
    ).where("trained or last")
    loss = F.when(F.col("trained"), F.col("body_len")).otherwise(0)
    out = t.select("conv_id", (F.col("seen") + F.when(F.col("trained"), 0).otherwise(1)).cast("int").alias("example"), F.when(F.col("trained"), F.col("place")).alias("target_turn"), F.array_join("blocks", "").alias("formatted"), loss.alias("loss_len"))
    return out.withColumn("loss_start", F.when(F.col("target_turn").isNull(), 0).otherwise(F.length("formatted") - len(END) - F.col("loss_len"))).select("conv_id", "example", "target_turn", "formatted", "loss_start", "loss_len")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>: the inverse of the template."""
    pieces = F.split(formatted, r"<\|im_end\|>")
    inner = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(inner, lambda p: F.struct(unescape(F.substring_index(p, SEP, 1)).alias("role"), unescape(F.substr(p, F.length(F.substring_index(p, SEP, 1)) + len(SEP) + 1)).alias("text")))


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The text under an example's loss mask, as it was before escaping."""
    return unescape(F.substr(formatted, start + 1, length))


def digests(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from them: the turns of the
    longest example, and the text under the mask of each."""
    read = examples.select("conv_id", "example", "formatted", F.when(F.col("target_turn").isNull(), F.lit("")).otherwise(read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_len"))).alias("loss"))
    g = read.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("whole"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum(F.length("formatted")).alias("formatted_chars"))
    g = g.select("conv_id", read_turns(F.col("whole")).alias("turns"), F.array_join(F.col("losses.loss"), "").alias("loss"), "formatted_chars")
    return g.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )

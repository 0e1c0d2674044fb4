"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Template: every turn is `<|turn|>role<|text|>text<|end|>`.  In roles and texts a backslash is doubled and one backslash is
put after the first character of each control string, so a control string never stands inside a text, and reading back
takes both steps away again.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks, and the control strings that texts may not contain.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = r"(<)(\||/s>|s>)|(\[)(/?INST\])"
CONTROL_OUT = r"$1$3\\$2$4"
ESCAPED = r"(<|\[)\\(?=\||/s>|s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, CONTROL_OUT)


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, ESCAPED, "$1"), F.lit("\\\\"), F.lit("\\"))


def expand(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, example, trainable, formatted, loss_start, loss_end.

    Each assistant turn becomes an example: all turns before it as context, then its own, and only its text is under the
    loss mask, the code points [loss_start, loss_end) of formatted.  Where a conversation does not end with an assistant
    turn a last example holds all its turns with an empty mask, so nothing of the input is lost.  Null texts and roles are
    empty; turns are ordered by (turn, role, text), null first; repeated rows stay; a null conv_id is a conversation of its
    own; an empty table gives no rows; other columns are ignored.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("said"))
    parts = whole.select(
        "conv_id",
        F.transform("said", lambda t: F.struct(
            (t["role"] == "assistant").alias("ours"),
            F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"),
            escape(t["text"]).alias("body"),
        )).alias("parts"),
    )
    at = parts.select("conv_id", "parts", F.posexplode("parts").alias("pos", "part")).filter(
        F.col("part.ours") | (F.col("pos") == F.size("parts") - 1)
    )
    context = F.concat_ws("", F.transform(F.slice("parts", F.lit(1), F.col("pos")), lambda p: F.concat(p["head"], p["body"], F.lit(END))))
    start = F.length("context") + F.length("part.head")
    return at.withColumn("context", context).select(
        "conv_id",
        F.col("pos").alias("example"),
        F.col("part.ours").alias("trainable"),
        F.concat("context", "part.head", "part.body", F.lit(END)).alias("formatted"),
        start.cast("int").alias("loss_start"),
        (start + F.when(F.col("part.ours"), F.length("part.body")).otherwise(0)).cast("int").alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples say: one row for each conversation, with its turns parsed from its longest example and
    the texts under the loss masks.  expand() has already dealt rows by conv_id, so this adds no exchange."""
    masked = unescape(F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)"))
    by_conv = examples.select("conv_id", "example", "trainable", "formatted", masked.alias("loss")).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("trainable"), F.struct("example", "loss")))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    pieces = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p != "")
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"), unescape(F.substring_index(p, TEXT, -1)).alias("text")
    )
    return by_conv.select("conv_id", F.transform(pieces, turn).alias("turns"), F.transform("losses", lambda x: x["loss"]).alias("losses"), "formatted_chars")


def digest(read: DataFrame) -> DataFrame:
    """Counts and digests of what read_back() found."""
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", "losses")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )

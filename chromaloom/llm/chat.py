"""Chat formatting by prefix-target expansion: one example for each assistant turn, only that reply trainable.

Template of a turn: ``<|turn|>role<|says|>text<|end|>``. In roles and texts a backslash is doubled and
``<|`` becomes ``<\\|``, so no control string can stand inside them and both can be read back. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the template.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    opened = F.replace(text, F.lit("<\\|"), F.lit("<|"))
    return F.replace(opened, F.lit("\\\\"), F.lit("\\"))


def examples(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end, last): the training examples.

    For every assistant turn: all turns up to and with it, and the code points [loss_start, loss_end) of
    ``formatted`` that are trainable, which is the reply's own (escaped) text. A conversation that does not
    end in a reply gets one more example of all its turns with an empty loss span, so no turn is lost.
    ``last`` marks the example that holds the whole conversation.

    Turns are ordered by number (null first), ties by role and text; repeated rows are repeated turns. Null
    texts and roles count as empty; rows with a null conversation form one conversation. Other columns are
    not looked at; an empty table gives an empty result. One conversation has to fit a row, as its longest
    example holds all of it; the prefixes are cut one at a time from one formatted text.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), empty).alias("role"),
        F.coalesce(F.col(text_col), empty).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    body = escape(F.col("text"))
    shown = rows.select(
        "conv_id",
        F.row_number().over(order).alias("at"),
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS), body, F.lit(END)).alias("piece"),
        F.length(body).alias("body"),
        (F.col("role") == "assistant").alias("reply"),
        "turn",
        "role",
        "text",
    )
    so_far = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = shown.withColumn("end", so_far).select("conv_id", F.struct("at", "piece", "reply", "end", "body").alias("t"))
    gathered = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    cuts = F.filter("ts", lambda t: t["reply"] | (t["at"] == F.size("ts")))
    spans = F.transform(
        cuts,
        lambda t: F.struct(
            F.when(t["reply"], t["end"] - len(END) - t["body"]).otherwise(t["end"]).alias("loss_start"),
            F.when(t["reply"], t["end"] - len(END)).otherwise(t["end"]).alias("loss_end"),
            t["end"].alias("end"),
            (t["at"] == F.size("ts")).alias("last"),
        ),
    )
    whole = F.array_join(F.transform("ts", lambda t: t["piece"]), "")
    cut = gathered.select("conv_id", whole.alias("whole"), F.posexplode(spans).alias("example", "cut"))
    return cut.select(
        "conv_id",
        "example",
        F.expr("substring(whole, 1, CAST(cut.end AS INT))").alias("formatted"),
        "cut.loss_start",
        "cut.loss_end",
        "cut.last",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) parsed out of ``examples``.

    Turns come from the example that holds the whole conversation, loss texts from the spans of all.
    """
    says, end = len(SAYS), len(END)
    pieces = F.expr(f"slice(split(formatted, '\\\\Q{TURN}\\\\E'), 2, greatest(size(split(formatted, '\\\\Q{TURN}\\\\E')) - 1, 0))")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, SAYS, 1)
        text = F.substring(piece, F.length(role) + says + 1, F.length(piece) - F.length(role) - says - end)
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    said = F.when(F.col("last"), F.array_join(F.transform(pieces, turn), ""))
    count = F.when(F.col("last"), F.size(pieces)).cast("long")
    loss = unescape(F.expr("substring(formatted, CAST(loss_start + 1 AS INT), CAST(loss_end - loss_start AS INT))"))
    parts = formatted.select(
        "conv_id", said.alias("said"), count.alias("n"), F.struct("example", loss.alias("loss")).alias("l"), F.length("formatted").alias("chars")
    )
    read = parts.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.sha2(F.max("said").cast("binary"), 256).alias("turns_sha256"),
        F.sort_array(F.collect_list("l")).alias("ls"),
        F.sum("chars").alias("formatted_chars"),
    )
    all_loss = F.array_join(F.transform("ls", lambda x: x["loss"]), "")
    return read.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length(all_loss).cast("long").alias("loss_chars"),
        F.sha2(all_loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )

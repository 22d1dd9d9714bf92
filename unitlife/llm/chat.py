"""Operator 6: conversations as budgeted, turn-aligned training windows.

Prefix sums of turn tokens choose the windows: a window takes new turns as long as they fit beside what it repeats, so
no turn is cut and every turn is new in exactly one window. A window repeats the conversation's system
turn and the turns that began in the last ``history`` tokens before it, fewer where its first new turn needs the
room; repeated turns carry no loss, and of the new ones only the assistant's do. System turn, history and
new turns together keep to the budget; only a turn that with the system turn is longer than it makes a longer window, without
history or a second new turn.

Template: ``<s>role[INST]text[/INST]``, closed by ``</s>`` instead where the text is a target. A control
string inside a role or text gets a backslash after its first character (one more, if there are
some), so none can occur and the change can be undone.

Column functions only. Running sums go over pieces of ``PIECE`` turns, whose totals are summed in turn, so
a long conversation is spread over tasks. Windows are chosen one after the other inside a block of ``BLOCK`` budgets
of tokens, of which at most one in eight starts a turn; the first turn of a block opens a window.

A null role or text is empty, null turns come first and turns of equal number are ordered by role and
text. Text is never cut. Rows with a null
conversation id form one conversation. Repeated rows are turns of their own. Other columns are left out;
an empty table gives no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 2048, 512
TURN_TOKENS = 8  # what the template adds to a turn
PIECE = 4096
BLOCK = 16
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"
START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"(/?s>|/?INST\]|</?SYS>>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){CONTROL}", "$1$2$3")


def token_estimate(text: Column) -> Column:
    """Four bytes a token."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def _placed(df: DataFrame, tokens, piece: int) -> DataFrame:
    """Turns with their number in the conversation (``at``), the tokens before them (``start``) and those of the
    conversation's system turn (``system``, 0 without one)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = df.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"),
        (tokens(text) + TURN_TOKENS).alias("cost"), F.floor(F.col("turn") / piece).alias("piece"))
    inside = Window.partitionBy("conv_id", "piece").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_conv").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        turns.groupBy(F.col("conv_id").alias("_conv"), F.col("piece").alias("_piece"))
        .agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("turns"),
             F.min(F.struct("turn", "role", "text", "cost")).alias("first"))
        .withColumn("first", F.min("first").over(Window.partitionBy("_conv")))
        .select("_conv", "_piece", F.coalesce(F.sum("cost").over(earlier), F.lit(0)).alias("cost_before"),
                F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"),
                F.when(F.col("first.role") == SYSTEM_ROLE, F.col("first.cost")).otherwise(0).alias("system"))
    )
    summed = turns.withColumns({"upto": F.sum("cost").over(inside), "row": F.row_number().over(inside)})
    return summed.join(
        totals, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("piece").eqNullSafe(F.col("_piece"))
    ).select("conv_id", "role", "text", "cost", "system", (F.col("turns_before") + F.col("row") - 1).alias("at"),
             (F.col("cost_before") + F.col("upto") - F.col("cost")).alias("start"))


def _copies(turns: DataFrame, budget: int, history: int, block: int) -> DataFrame:
    """``conv_id, at, window, repeated``: the turns of every window, by number."""
    size = block * budget
    own = F.floor(F.col("start") / size)
    late = (own + 1) * size - F.col("start") <= history  # may be history of the next block's first windows
    spread = turns.select("conv_id", "at", "start", "cost", "system", own.alias("own"), F.explode(
        F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("block"))
    lately = Window.partitionBy("conv_id", "block").orderBy("start").rangeBetween(-history - 1, -1)
    spoken = F.when((F.col("at") > 0) | (F.col("system") == 0), F.struct("start", "at"))
    again = F.when(F.col("at") > 0, F.col("system")).otherwise(0)
    allowed = F.least(F.lit(history), budget - F.col("again") - F.col("cost"))
    first = F.array_min(F.filter("before", lambda t: t["start"] >= F.col("start") - F.col("allowed")))
    asked = (
        spread.withColumns({"before": F.collect_list(spoken).over(lately), "again": again})
        .filter(F.col("own") == F.col("block")).withColumn("allowed", allowed).withColumn("first", first)
        .select("conv_id", "block", F.struct(
            "at", "start", (F.col("start") + F.col("cost")).alias("end"),
            # until where the window reaches that this turn opens, and its first repeated turn
            F.greatest(F.col("start") + F.col("cost"), budget - F.col("again") + F.coalesce("first.start", "start")).alias("until"),
            F.coalesce("first.at", "at").alias("back"), (F.col("again") > 0).alias("system")).alias("turn"))
        .groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    )
    opened = F.aggregate(
        "turns",
        F.struct(F.expr("CAST(array() AS array<struct<at: bigint, back: bigint, system: boolean>>)").alias("list"),
                 F.lit(-1).cast("bigint").alias("until")),
        lambda done, t: F.when(t["end"] <= done["until"], done).otherwise(F.struct(
            F.concat(done["list"], F.array(F.struct(t["at"].alias("at"), t["back"].alias("back"), t["system"].alias("system")))).alias("list"),
            t["until"].alias("until"))),
        lambda done: done["list"])
    copy = lambda at, window, repeated: F.struct(
        at.alias("at"), window.alias("window"), F.lit(repeated).alias("repeated"))
    new = F.transform("turns", lambda t: copy(
        t["at"], F.array_max(F.filter(F.transform("opened", lambda w: w["at"]), lambda at: at <= t["at"])), False))
    kept = F.flatten(F.transform("opened", lambda w: F.transform(
        F.concat(F.when(w["system"], F.array(F.lit(0).cast("bigint"))).otherwise(F.expr("CAST(array() AS array<bigint>)")),
                 F.when(w["back"] < w["at"], F.sequence(w["back"], w["at"] - 1)).otherwise(F.expr("CAST(array() AS array<bigint>)"))),
        lambda at: copy(at, w["at"], True))))
    return asked.withColumn("opened", opened).select("conv_id", F.inline(F.concat(new, kept)))


def windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=token_estimate,
            piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """``conv_id, window, formatted, n_turns, n_repeated, loss`` from rows of ``conv_id, turn, role, text``.

    ``window`` is the number of its first new turn in the conversation. ``loss`` lists the target spans of ``formatted``
    (code points, end exclusive); its first ``n_repeated`` turns occur in an earlier window. ``tokens`` maps a text column
    to its token count, of which the budget holds (with ``TURN_TOKENS`` a turn).
    """
    turns = _placed(df, tokens, piece)
    copies = _copies(turns, budget, history, block).withColumnsRenamed({"conv_id": "_conv", "at": "_at"})
    placed = turns.join(copies, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_at"))).select(
        "conv_id", "role", "text", "at", "window", "repeated")

    target = (F.col("role") == TARGET_ROLE) & ~F.col("repeated")
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(OPEN))
    pieces = (
        placed.withColumns({"head": head, "body": escaped(F.col("text")), "target": target})
        .withColumn("turn", F.concat("head", "body", F.when(F.col("target"), END).otherwise(CLOSE)))
    )
    before = Window.partitionBy("conv_id", "window").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    spot = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head")
    return (
        pieces.withColumn("from", spot)
        .select("conv_id", "window", "repeated", F.struct(
            "at", "turn", "target", F.col("from").alias("start"),
            (F.col("from") + F.length("body")).alias("end")).alias("part"))
        .groupBy("conv_id", "window")
        .agg(F.sort_array(F.collect_list("part")).alias("parts"),
             F.sum(F.col("repeated").cast("bigint")).alias("n_repeated"))
        .select(
            "conv_id", "window", F.array_join(F.transform("parts", lambda p: p["turn"]), "").alias("formatted"),
            F.size("parts").cast("bigint").alias("n_turns"), "n_repeated",
            F.transform(F.filter("parts", lambda p: p["target"]), lambda p: F.struct(
                p["start"].cast("bigint").alias("start"), p["end"].cast("bigint").alias("end"))).alias("loss"))
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``windows`` with ``turns`` (the new turns as role and text) and ``targets`` (texts under the loss mask),
    both unescaped, parsed from ``formatted`` and ``loss``."""
    def turn(t: Column) -> Column:
        body = F.substring(t, F.instr(t, OPEN) + F.lit(len(OPEN)), F.length(t))
        closed = F.when(F.endswith(t, F.lit(END)), len(END)).otherwise(len(CLOSE))
        return F.struct(unescaped(F.substring_index(t, OPEN, 1)).alias("role"),
                        unescaped(F.substring(body, F.lit(1), F.length(body) - closed)).alias("text"))

    parts = F.split("formatted", START, -1)
    new = F.slice(parts, F.col("n_repeated").cast("int") + 2, F.size(parts))
    return formatted.withColumns({
        "turns": F.transform(new, turn),
        "targets": F.transform("loss", lambda s: unescaped(
            F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))),
    })

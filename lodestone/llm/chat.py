"""Chat formatting in budgeted windows, with DataFrame and SQL functions only.

A turn becomes ``<|role|>`` newline, text, ``<|end|>`` newline.  In roles and
texts ``&``, ``<`` and ``>`` are written as entities, so a control string never
occurs inside a text and unescaping gives the text back.

Tokens are counted per turn (from a column of the caller's; without one, words and
single other characters; plus four for the marks), and their prefix sums choose windows: a window starts with the
system turn, repeats at most ``history_turns`` earlier turns of at most
``history_tokens`` tokens in all, and takes on new turns as long as the budget
lasts, one at least.  The loss mask lists the spans of the assistant texts among
a window's new turns; repeated turns are never in it, so each assistant text is
a target once.

The rows of a conversation meet in one row, since its windows are strings over
all its turns; prefix sums are window functions over the same partitioning.

Defined results: null text counts as empty, null role as an empty role; rows go
by turn, null first, then role and text; rows that repeat are turns of their
own; rows without conv_id form one conversation; a very long text is a window of
its own; other columns of any name are ignored; an empty table gives no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY_TOKENS, HISTORY_TURNS, MARK_TOKENS = 512, 128, 4, 4
END = "<|end|>\n"


def escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in (("<", "&lt;"), (">", "&gt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def count_tokens(text: Column) -> Column:
    """Words and single characters that are neither word nor space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])")))


def format_windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history_tokens: int = HISTORY_TOKENS,
    history_turns: int = HISTORY_TURNS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    tokens_col: str | None = None,
) -> DataFrame:
    """One row per window: conv_id, window, has_system, n_history, n_new, tokens,
    formatted, loss (spans of code points: start, length).

    ``tokens_col`` names a column with the tokens of each text by the tokenizer of the
    model that is to be trained (``token_counts.prefix_counts`` fills one); null counts
    as by ``count_tokens``.
    """
    own = count_tokens(F.col("text")) if tokens_col is None else F.coalesce(F.col("own"), count_tokens(F.col("text")))
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        (F.lit(None) if tokens_col is None else F.col(tokens_col)).cast("int").alias("own"),
    )
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    body = escape(F.col("text"))
    rows = rows.select(
        "conv_id", "turn", "role", "text",
        F.concat(head, body, F.lit(END)).alias("block"),
        F.length(head).alias("head"),
        F.length(body).alias("body"),
        (own + MARK_TOKENS).alias("tokens"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(
        "conv_id", "role", "block", "head", "body", "tokens",
        F.row_number().over(order).alias("n"),
        F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("chars"),
    )
    turns = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "role", "block", "head", "body", "tokens", "upto", "chars"))).alias("t")
    )
    turns = turns.select("conv_id", "t", F.when(F.col("t")[0]["role"] == "system", 1).otherwise(0).alias("sys"))
    turns = turns.select("conv_id", "t", "sys", F.when(F.col("sys") == 1, F.col("t")[0]["tokens"]).otherwise(0).alias("sys_tokens"))

    # Positions count from 1; a window is (h: first history turn, s: first new turn, e: last).
    # The history of a window that starts at i: the longest run before i within both limits.
    starts = f"filter(sequence(0, {history_turns}), k -> i - k > sys AND t[i - 2].upto - IF(i - k - 2 < 0, 0, t[i - k - 2].upto) <= {history_tokens})"
    history = f"i - coalesce(array_max({starts}), 0)"
    used = "sys_tokens + t[i - 1].upto - IF(w.h < 2, 0, t[w.h - 2].upto)"
    fold = F.expr(
        f"""aggregate(
          IF(size(t) > sys, sequence(sys + 1, size(t)), cast(array() as array<int>)),
          named_struct('h', sys + 1, 's', sys + 1, 'out', cast(array() as array<struct<h: int, s: int, e: int>>)),
          (w, i) -> IF(i > w.s AND {used} > {budget},
             named_struct('h', cast({history} as int), 's', i, 'out', concat(w.out, array(named_struct('h', w.h, 's', w.s, 'e', i - 1)))),
             w),
          w -> concat(w.out, array(named_struct('h', w.h, 's', w.s, 'e', size(t)))))"""
    )
    spans = turns.select("conv_id", "t", "sys", "sys_tokens", F.posexplode(fold).alias("window", "w"))
    before_history = "IF(w.h < 2, 0, t[w.h - 2].chars)"
    return spans.select(
        "conv_id",
        F.col("window").cast("long").alias("window"),
        (F.col("sys") == 1).alias("has_system"),
        (F.col("w.s") - F.col("w.h")).alias("n_history"),
        (F.col("w.e") - F.col("w.s") + 1).alias("n_new"),
        F.expr("sys_tokens + IF(w.e < w.h, 0, t[w.e - 1].upto - IF(w.h < 2, 0, t[w.h - 2].upto))").cast("long").alias("tokens"),
        F.expr("array_join(transform(concat(slice(t, 1, sys), slice(t, w.h, w.e - w.h + 1)), x -> x.block), '')").alias("formatted"),
        F.expr(
            f"""transform(filter(slice(t, w.s, w.e - w.s + 1), x -> x.role = 'assistant'), x -> named_struct(
              'start', cast(IF(sys = 1, t[0].chars, 0) + x.chars - length(x.block) - {before_history} + x.head as int),
              'length', x.body))"""
        ).alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """What formatted windows say: conv_id, turns (role, text) and targets (texts
    under the loss mask, unescaped) in order, formatted_chars."""
    blocks = "filter(split(formatted, '<\\\\|end\\\\|>\\\\n'), b -> b != '')"
    first = "IF(has_system AND window > 0, 1, 0)"
    new = F.expr(f"slice({blocks}, {first} + n_history + 1, size({blocks}))")
    parsed = F.transform(
        new,
        lambda b: F.struct(
            unescape(F.regexp_extract(b, r"(?s)^<\|(.*?)\|>\n(.*)$", 1)).alias("role"),
            unescape(F.regexp_extract(b, r"(?s)^<\|(.*?)\|>\n(.*)$", 2)).alias("text"),
        ),
    )
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    read = windows.select("conv_id", "window", parsed.alias("turns"), targets.alias("targets"), F.length("formatted").alias("chars"))
    grouped = read.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    return grouped.select(
        "conv_id",
        F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"),
        F.flatten(F.transform("w", lambda x: x["targets"])).alias("targets"),
        "formatted_chars",
    )

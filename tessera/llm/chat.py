"""Chat formatting with budgeted windows (operator 1).

Each conversation becomes one or more windows.  Prefix sums of the turns' token estimates choose
turn-aligned spans: a window holds the leading system turn, as many of the last turns before the
span as fit ``history_tokens``, and the new turns that fit what is left of ``budget_tokens``.  A
turn that alone exceeds it gets a window of its own, whole.  Turns that stand in a window again
are marked ``<again:`` and are never targets, so each assistant text is under the loss mask once.

Template: ``<turn:ROLE>`` newline TEXT ``</turn>`` newline.  Inside roles and texts a backslash
becomes ``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``; no control string can then occur
in them, and ``unescape`` gives the text back exactly.

Only DataFrame functions run.  Rows are shuffled once, by conversation; a conversation is one
unit of output, so its turns meet in one row, and different conversations never do.  Each window takes
its own slice of that row, so memory grows with the length of a conversation, not with its square.

Defined results: a null text or role counts as empty; rows of one conversation are ordered by
turn (nulls first), role, text, and repeated rows all stay; rows with a null id form one
conversation; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET_TOKENS = 1024
HISTORY_TOKENS = 192
CHARS_PER_TOKEN = 4
END = "</turn>\n"


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for coded, plain in (("\\g", ">"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _again(piece: Column) -> Column:
    return F.concat(F.lit("<again:"), F.substring(piece, len("<turn:") + 1, 2**31 - 1))


def _window(i: Column, history_tokens: int) -> Column:
    """What window i of a conversation holds: its own slices, so that no window carries the whole conversation."""
    low, high = F.get("starts", i), F.coalesce(F.get("starts", i + 1), F.size("body"))
    last = F.get("body", low - 1)
    before = F.coalesce(last["token_sum"], F.lit(0))
    # Every turn has a token at least, so no more than history_tokens turns can fit.
    least = F.greatest(F.lit(0), low - history_tokens)
    return F.struct(
        i.cast("long").alias("window_id"),
        F.col("system").alias("system"),
        F.col("system_tokens").alias("system_tokens"),
        F.coalesce(last["char_sum"], F.lit(0)).alias("chars_before"),
        F.filter(F.slice("body", least + 1, low - least), lambda t: before - (t["token_sum"] - t["tokens"]) <= history_tokens).alias("history"),
        F.slice("body", low + 1, high - low).alias("new"),
    )


def format_windows(conversations: DataFrame, budget_tokens: int = BUDGET_TOKENS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """Rows: conv_id, window_id, n_new, n_history, n_tokens, formatted, loss_spans.

    ``loss_spans`` lists (start, length) in code points of ``formatted``: the escaped text of each
    new assistant turn.
    """
    if not 0 <= history_tokens < budget_tokens:
        raise ValueError("history_tokens must be less than budget_tokens")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit("<turn:"), escape(role), F.lit(">\n"))
    rows = conversations.select(
        "conv_id",
        F.col("turn").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.length(head).alias("head_chars"),
        F.concat(head, escape(text), F.lit(END)).alias("piece"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("is_system", (F.col("n") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("tokens", F.ceil(F.length("piece") / CHARS_PER_TOKEN).cast("long"))
    body = lambda c: F.when(F.col("is_system"), F.lit(0)).otherwise(F.col(c)).cast("long")
    sums = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {
            "token_sum": F.sum(body("tokens")).over(sums),
            "char_sum": F.sum(F.when(F.col("is_system"), F.lit(0)).otherwise(F.length("piece")).cast("long")).over(sums),
        }
    )
    turn = F.struct("n", "is_system", (F.col("role") == "assistant").alias("target"), "head_chars", "piece", "tokens", "token_sum", "char_sum")
    g = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    g = g.withColumns(
        {
            "system": F.filter("turns", lambda t: t["is_system"]),
            "body": F.filter("turns", lambda t: ~t["is_system"]),
        }
    )
    g = g.withColumn("system_tokens", F.coalesce(F.get("system", F.lit(0))["tokens"], F.lit(0)).cast("long"))
    room = F.greatest(F.lit(budget_tokens - history_tokens) - F.col("system_tokens"), F.lit(1))
    # A new span begins at the first turn whose prefix sum leaves the room counted from the span's start.
    first = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).cast("long").alias("base"), F.lit(0).alias("i"))
    step = lambda a, t: F.when(
        (t["token_sum"] - a["base"] > room) & (t["token_sum"] - t["tokens"] > a["base"]),
        F.struct(F.concat(a["starts"], F.array(a["i"])).alias("starts"), (t["token_sum"] - t["tokens"]).alias("base"), (a["i"] + 1).alias("i")),
    ).otherwise(F.struct(a["starts"].alias("starts"), a["base"].alias("base"), (a["i"] + 1).alias("i")))
    g = g.withColumn("starts", F.aggregate("body", first, step, lambda a: a["starts"]))
    g = g.select("conv_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("starts") - 1), lambda i: _window(i, history_tokens))).alias("w"))
    w = g.select("conv_id", "w.*")
    texts = lambda c, f: F.array_join(F.transform(c, f), "")
    lead = F.concat(
        texts("system", lambda t: F.when(F.col("window_id") == 0, t["piece"]).otherwise(_again(t["piece"]))),
        texts("history", lambda t: _again(t["piece"])),
    )
    w = w.withColumn("lead", lead)
    spans = F.transform(
        F.filter("new", lambda t: t["target"]),
        lambda t: F.struct(
            (F.length("lead") + t["char_sum"] - F.length(t["piece"]) - F.col("chars_before") + t["head_chars"]).cast("long").alias("start"),
            (F.length(t["piece"]) - t["head_chars"] - len(END)).cast("long").alias("length"),
        ),
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    return w.select(
        "conv_id",
        "window_id",
        F.size("new").cast("long").alias("n_new"),
        F.size("history").cast("long").alias("n_history"),
        (F.col("system_tokens") + total("history") + total("new")).alias("n_tokens"),
        F.concat("lead", texts("new", lambda t: t["piece"])).alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted text says, read from it alone: the digest columns of query op1."""
    pieces = F.filter(F.split("formatted", END), lambda x: F.startswith(x, F.lit("<turn:")))

    def turn(x: Column) -> Column:
        inner = F.substring(x, len("<turn:") + 1, 2**31 - 1)
        role = F.substring_index(inner, ">", 1)
        return F.concat(unescape(role), F.lit("\n"), unescape(F.substr(inner, F.length(role) + 3)), F.lit("\n"))

    losses = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    each = windows.select(
        "conv_id", "window_id", F.length("formatted").cast("long").alias("chars"), F.transform(pieces, turn).alias("turns"), losses.alias("losses")
    )
    g = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window_id", "turns", "losses"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns, losses = F.flatten(F.col("w.turns")), F.flatten(F.col("w.losses"))
    text = F.array_join(losses, "")
    return g.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"),
        F.sha2(text, 256).alias("loss_sha256"),
        "formatted_chars",
    )

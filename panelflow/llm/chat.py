"""Chat formatting into budgeted, turn-aligned windows with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.session import stored

# The template. A turn is OPEN role \n text CLOSE.
OPEN, CLOSE = "<|turn|>", "<|end|>"
# Control strings need a raw "<" or "["; both are escaped inside roles and texts, and so is the escape.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\o"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def token_count(text: Column) -> Column:
    """Turn tokens of the budget: a token for every four code points begun, and four for the markers."""
    return F.ceil(F.char_length(text) / 4).cast("long") + 4


def format_windows(
    turns: DataFrame, budget: int = 1024, history: int = 256,
    conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per window: conv, window_no, n_parts, tokens, formatted, parts.

    parts lists the turns of a window in order: turn_no (position in the conversation), fresh (false for
    the retained system turn and repeated history), role_start, role_end, start, end (code points of
    `formatted`, end exclusive, of the escaped role and text), loss. The loss mask is the parts with
    loss: texts of fresh assistant turns. Repeated assistant turns are masked, so every assistant text
    is trained on once.

    Prefix sums of turn tokens choose the spans. A turn of more than stride = (budget - history) / 2
    tokens is a span of its own; the others share a span while their prefix sums start in the same cell
    of stride tokens, so such a span has fewer than 2 * stride. Before its span a window retains the
    conversation's first turn, where that is a system turn, and repeats the turns whose prefix sum starts at most
    `history` tokens before the span. Windows exceed the budget only by the system turn or by a
    single turn longer than it: turns are never cut.

    Turns are ordered by turn, then role and text, nulls first. Null text and null role count as empty,
    a null conversation id is a conversation of its own, repeated rows are turns of their own, and an
    empty table gives no window. Further columns are not read. `formatted` is bounded by the budget,
    whatever the length of the conversation.
    """
    if not 0 <= history < budget // 2:
        raise ValueError("history must be below half the budget")
    stride = (budget - history) // 2
    ordered = Window.partitionBy("_c").orderBy("_t", "_r", "_x")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select(
        F.col(conv).alias("_c"), F.col(turn).alias("_t"),
        F.coalesce(F.col(role), F.lit("")).alias("_r"), F.coalesce(F.col(text), F.lit("")).alias("_x"),
    )
    rows = rows.withColumn("_tok", token_count(F.col("_x"))).select(
        "*", (F.row_number().over(ordered) - 1).cast("long").alias("_no"),
        F.coalesce(F.sum("_tok").over(before), F.lit(0)).alias("_from"),
        (F.col("_tok") > stride).alias("_long"),
    )
    key = F.struct(
        F.coalesce(F.sum(F.col("_long").cast("int")).over(before), F.lit(0)), F.col("_long"),
        F.when(~F.col("_long"), F.floor(F.col("_from") / stride)),
    )
    rows = rows.withColumn("_key", key)
    opens = ~F.col("_key").eqNullSafe(F.lag("_key").over(ordered)) | (F.col("_no") == 0)
    rows = rows.withColumn("_opens", opens).withColumn(
        "_span", F.sum(F.col("_opens").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    placed = stored(rows.select(
        "_c", "_no", "_tok", "_from", "_span", "_opens", escape(F.col("_r"), ROLE_ESCAPES).alias("_r"),
        escape(F.col("_x")).alias("_x"),
    ), "chat-turns")

    spans = placed.filter("_opens").select(F.col("_c").alias("_sc"), F.col("_span").alias("_w"), F.col("_from").alias("_at"))
    fresh = placed.select("*", F.col("_span").alias("_w"), F.lit(True).alias("_fresh"))
    # Spans that begin at most `history` tokens after a turn: each long one is over stride tokens, so there are
    # history // stride + 1 of them at most; they and the history // stride + 1 cells that begin there part the short ones.
    following = 3 if history <= stride else 3 * (history // stride) + 4
    again = placed.select("*", F.explode(F.array(*[F.col("_span") + k for k in range(1, following + 1)])).alias("_w"))
    here = F.col("_c").eqNullSafe(F.col("_sc"))
    repeated = again.join(spans, here & (again["_w"] == spans["_w"])).filter(F.col("_at") - F.col("_from") <= history)
    system = placed.filter((F.col("_no") == 0) & (F.col("_r") == "system"))
    retained = system.join(spans.filter("_w > 0"), here)
    kept = repeated.drop("_sc", "_at").drop(spans["_w"]).withColumn("_fresh", F.lit(False))
    retained = retained.drop("_sc", "_at").withColumn("_fresh", F.lit(False))
    # a system turn may also be within the repeated history: it stands once
    parts = fresh.unionByName(kept.filter((F.col("_no") > 0) | (F.col("_r") != "system"))).unionByName(retained)

    in_window = Window.partitionBy("_c", "_w").orderBy("_no")
    piece = F.concat(F.lit(OPEN), F.col("_r"), F.lit("\n"), F.col("_x"), F.lit(CLOSE))
    parts = parts.withColumn("_piece", piece).withColumn(
        "_off", F.coalesce(F.sum(F.char_length("_piece")).over(in_window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    role_end = F.col("_off") + len(OPEN) + F.char_length("_r")
    one = F.struct(
        F.col("_no").alias("turn_no"), F.col("_fresh").alias("fresh"),
        (F.col("_off") + len(OPEN)).alias("role_start"), role_end.alias("role_end"),
        (role_end + 1).alias("start"), (role_end + 1 + F.char_length("_x")).alias("end"),
        (F.col("_fresh") & (F.col("_r") == "assistant")).alias("loss"), F.col("_piece").alias("piece"),
    )
    return (
        parts.groupBy("_c", "_w").agg(F.array_sort(F.collect_list(one)).alias("_p"), F.sum("_tok").alias("tokens"))
        .select(
            F.col("_c").alias(conv), F.col("_w").alias("window_no"), F.size("_p").cast("long").alias("n_parts"), "tokens",
            F.concat_ws("", F.transform("_p", lambda p: p["piece"])).alias("formatted"),
            F.transform("_p", lambda p: p.dropFields("piece")).alias("parts"),
        )
    )


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Turns and loss of each conversation, read from the formatted windows by their spans."""
    def cut(p, a, b, pairs=ESCAPES):
        return unescape(F.substr(F.col("formatted"), (p[a] + 1).cast("int"), (p[b] - p[a]).cast("int")), pairs)

    new = F.filter("parts", lambda p: p["fresh"])
    loss = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: cut(p, "start", "end"))
    said = F.transform(new, lambda p: F.concat(
        cut(p, "role_start", "role_end", ROLE_ESCAPES), F.lit("\n"), cut(p, "start", "end"), F.lit("\n")))
    by_window = windows.select(
        F.col(conv), "window_no", F.size(new).alias("n"), F.concat_ws("", said).alias("said"),
        F.concat_ws("", loss).alias("loss"), F.char_length("formatted").cast("long").alias("chars"),
    )
    # one string per conversation is what its digest is taken of
    joined = by_window.groupBy(conv).agg(
        F.array_sort(F.collect_list(F.struct("window_no", "said", "loss"))).alias("w"),
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"))
    all_said, all_loss = (F.concat_ws("", F.transform("w", lambda x: x[f])) for f in ("said", "loss"))
    return joined.select(
        conv, "n_turns", F.sha2(all_said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(all_loss).cast("long").alias("loss_chars"),
        F.sha2(all_loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )

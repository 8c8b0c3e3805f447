"""Chat formatting: conversations as training windows within a token budget, with DataFrame operations only.

A turn is ``### role\\n`` + text + ``\\n</turn>\\n``. In texts and roles a backslash goes before every backslash,
``###`` and ``</turn>``, so that no text holds a control string, and unescaping gives the text back.

Prefix sums of turn tokens cut a conversation into windows: turns whose sums end in one stretch of ``span`` tokens are
new in one window. A span is what the budget leaves beside history, system turn and longest turn, or half of the former
if turns are long. A window starts with the conversation's system turn and up to ``HISTORY_TURNS`` turns from before
it, within ``history`` tokens and what the system turn and the new turns leave of the budget; both are context. A long
system turn makes its conversation's spans shorter. Only texts of new assistant turns are under the loss mask, so each
is a target once. A turn is never cut: a window is over the budget only if a turn is longer than a span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segjobs.llm import base

BUDGET = 2048
HISTORY = 512
HISTORY_TURNS = 4
TURN_TOKENS = 4  # for a turn's control strings

# The template.
HEAD, END = "### ", "\n</turn>\n"


def escaped(x):
    return F.regexp_replace(x, r"(\\|###|</turn>)", r"\\$1")


def plain(x):
    """The inverse of escaped()."""
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def role_line(role):
    """An escaped role on one line: a line break becomes a backslash and n, which escaped() never makes."""
    return F.replace(escaped(role), F.lit("\n"), F.lit(r"\n"))


def role_of(line):
    """The inverse of role_line()."""
    parts = F.transform(F.split(line, r"\\\\", -1), lambda x: F.replace(x, F.lit(r"\n"), F.lit("\n")))
    return plain(F.array_join(parts, r"\\"))


def tokens(x):
    """Runs of letters, runs of digits, and other visible characters: what a sub-word tokenizer cannot join."""
    return F.regexp_count(x, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"))


def windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS
) -> DataFrame:
    """conv_id, window (a number, ascending), formatted, n_context (turns before the new ones), loss_spans (start, end),
    n_tokens.

    conversations: conv_id, turn, role, text; rows are ordered by turn, equal turns by role and text. A null text or
    role is an empty one; a null turn comes first; rows of null conv_id are one conversation. Repeated rows are turns of
    their own. An empty table gives no rows. Spans are code points of formatted, end exclusive. One shuffle by
    conversation and one by window; a conversation's turns are sorted in one task, as its windows follow from their
    order.
    """
    span = max(1, (budget - history) // 2)
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = turns.withColumn("tokens", (tokens(F.col("text")) + tokens(F.col("role")) + TURN_TOKENS).cast("long"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "tokens")
    turns = turns.withColumns(
        {
            "at": F.row_number().over(by).cast("long"),
            "upto": F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    first = Window.partitionBy("conv_id").orderBy("at")
    is_system = (F.col("at") == 1) & (F.col("role") == "system")
    turns = turns.withColumn(
        "system_tokens",
        F.first(F.when(is_system, F.col("tokens")).otherwise(0)).over(first.rowsBetween(Window.unboundedPreceding, 0)),
    )
    # The turn that a stretch begins within reaches into it by less than the longest turn: with that taken off, the new
    # turns
    # and all that the history can take fit. If turns are long, two half spans do instead, since turns of at most one
    # stay under both.
    whole = Window.partitionBy("conv_id")
    longest = F.coalesce(F.max(F.when(~is_system, F.col("tokens"))).over(whole), F.lit(0))
    half = F.least(F.lit(span), F.floor((budget - F.col("system_tokens") + 1) / 2))
    own_span = F.greatest(
        F.lit(1), half, budget - F.least(F.lit(history), history_turns * longest) - F.col("system_tokens") - longest + 1
    )
    turns = turns.withColumn("window", F.floor((F.col("upto") - 1) / own_span))
    turns = turns.withColumn(
        "room",
        F.least(
            F.lit(history),
            budget - F.col("system_tokens") - F.sum("tokens").over(Window.partitionBy("conv_id", "window")),
        ),
    )
    turns = turns.withColumn("head", F.concat(F.lit(HEAD), role_line(F.col("role")), F.lit("\n"))).withColumn(
        "body", escaped(F.col("text"))
    )
    turns = turns.withColumns(
        {
            "starts": F.col("window") != F.coalesce(F.lag("window").over(first), F.lit(-1)),
            "system": F.first(F.when(is_system, F.struct("at", "head", "body", "role", "tokens"))).over(
                first.rowsBetween(Window.unboundedPreceding, 0)
            ),
        }
    )
    # A turn goes to its own window as new, and as history to each window that starts within the next turns.
    later = [
        F.when(
            F.coalesce(F.lead("starts", k).over(first), F.lit(False)) & (
                F.lead(F.col("upto") - F.col("tokens"), k).over(first)
                - F.col("upto")
                + F.col("tokens") <= F.lead("room", k).over(first)
            ) & ~is_system,
            F.lead("window", k).over(first),
        )
        for k in range(1, history_turns + 1)
    ]
    turns = turns.withColumn("later", F.array_compact(F.array(*later)))
    entry = lambda window, at, new, of: F.struct(
        window.alias("window"),
        at.alias("at"),
        F.lit(new).alias("new"),
        of("head").alias("head"),
        of("body").alias("body"),
        of("role").alias("role"),
        of("tokens").alias("tokens"),
    )
    own = F.col
    entries = F.concat(
        F.array(entry(F.col("window"), F.col("at"), True, own)),
        F.transform("later", lambda w: entry(w, F.col("at"), False, own)),
        F.when(
            F.col("starts") & (F.col("at") > 1) & F.col("system").isNotNull(),
            F.array(entry(F.col("window"), F.lit(0).cast("long"), False, lambda x: F.col("system")[x])),
        ).otherwise(F.array()),
    )
    rows = turns.select("conv_id", F.explode(entries).alias("e")).select("conv_id", "e.*")
    rows = rows.withColumn("length", F.length("head") + F.length("body") + len(END))
    in_window = Window.partitionBy("conv_id", "window").orderBy("at")
    rows = rows.withColumn(
        "start",
        F.sum("length").over(in_window.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length") + F.length("head"),
    )
    made = F.struct(
        "at",
        "new",
        F.concat("head", "body", F.lit(END)).alias("s"),
        F.when(
            F.col("new") & (F.col("role") == "assistant"),
            F.struct(F.col("start").alias("start"), (F.col("start") + F.length("body")).alias("end")),
        ).alias("loss"),
    )
    grouped = rows.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(made)).alias("t"), F.sum("tokens").alias("n_tokens")
    )
    return grouped.select(
        "conv_id", "window", F.array_join(F.col("t.s"), "").alias("formatted"), F.size(
            F.filter("t", lambda x: ~x["new"])
        ).alias("n_context"),
        F.array_compact(F.col("t.loss")).alias("loss_spans"), "n_tokens",
    )


def read_back(made: DataFrame) -> DataFrame:
    """conv_id, window, turns (role, text) that are new in the window, and targets (the texts under its loss mask),
    unescaped."""
    pieces = F.transform(
        F.filter(F.split("formatted", END, -1), lambda x: x != ""), lambda x: F.substring(x, len(HEAD) + 1, 2**31 - 1)
    )
    turn = lambda x: F.struct(
        role_of(F.regexp_extract(x, r"^[^\n]*", 0)).alias("role"),
        plain(F.regexp_extract(x, r"(?s)^[^\n]*\n(.*)$", 1)).alias("text"),
    )
    new = F.slice(
        F.transform(pieces, turn), F.col("n_context") + 1, F.greatest(F.size(pieces) - F.col("n_context"), F.lit(0))
    )
    targets = F.transform(
        "loss_spans", lambda s: plain(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))
    )
    return made.select(
        "conv_id",
        "window",
        new.alias("turns"),
        targets.alias("targets"),
        F.length("formatted").cast("long").alias("chars"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = base.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    chats = chats.unionByName(
        spark.createDataFrame(
            [(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string"
        )
    )
    back = read_back(base.stored(windows(chats)))
    whole = back.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"),
        F.sum("chars").alias("formatted_chars"),
    )
    turns, targets = F.flatten(F.col("w.turns")), F.array_join(F.flatten(F.col("w.targets")), "")
    return whole.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
            256,
        ).alias("turns_sha256"),
        F.length(targets).cast("long").alias("loss_chars"), F.sha2(targets, 256).alias(
            "loss_sha256"
        ), "formatted_chars",
    )


QUERIES = {"op2_chat_format": op2_chat_format}
SQL = {
    "op2_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (
  SELECT *, len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]')) + len(regexp_extract_all(role, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]')) + 4 AS tokens,
    14 + length(role) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) AS size
  FROM c),
p AS (SELECT *, row_number() OVER w AS nth, sum(tokens) OVER w AS upto FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
o AS (
  SELECT *, coalesce(max(tokens) FILTER (nth = 1 AND role = 'system') OVER c, 0) AS sys, coalesce(max(tokens) FILTER (nth > 1 OR role <> 'system') OVER c, 0) AS longest
  FROM p WINDOW c AS (PARTITION BY conv_id)),
q AS (SELECT *, upto - tokens AS since, (upto - 1)::BIGINT // greatest(1, least(768, (2049 - sys)::BIGINT // 2), 2049 - least(512, 4 * longest) - sys - longest)::BIGINT AS win FROM o),
r AS (
  SELECT *, win <> coalesce(lag(win) OVER v, -1) AS starts, nth = 1 AND role = 'system' AS is_system, least(512, 2048 - sys - sum(tokens) OVER (PARTITION BY conv_id, win)) AS room
  FROM q WINDOW v AS (PARTITION BY conv_id ORDER BY nth)),
s AS (
  SELECT *, first_value(CASE WHEN is_system THEN size ELSE 0 END) OVER v AS system_size,
    coalesce((lead(starts, 1) OVER v AND lead(since, 1) OVER v - since <= lead(room, 1) OVER v)::INT, 0) + coalesce((lead(starts, 2) OVER v AND lead(since, 2) OVER v - since <= lead(room, 2) OVER v)::INT, 0)
    + coalesce((lead(starts, 3) OVER v AND lead(since, 3) OVER v - since <= lead(room, 3) OVER v)::INT, 0) + coalesce((lead(starts, 4) OVER v AND lead(since, 4) OVER v - since <= lead(room, 4) OVER v)::INT, 0) AS again
  FROM r WINDOW v AS (PARTITION BY conv_id ORDER BY nth))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size * (1 + CASE WHEN is_system THEN 0 ELSE again END) + CASE WHEN starts AND nth > 1 THEN system_size ELSE 0 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
""",
}

"""Chat formatting in budgeted windows, by DataFrame operations only.

Tokens of a turn are its words plus ``OVERHEAD`` for its marks. Prefix sums of them over the turns
of a conversation choose turn-aligned spans. A quarter of the budget is kept for the system turn and a
quarter for history; the other half is the room of a window's own turns. The conversation's tokens are
cut into cells of half that room: a turn belongs to the cell in which it ends, so a cell's turns and the
one that reaches into it fit the room, unless that one is longer than a cell: it is a window of its
own. Each window but the first begins with the system turn, if the conversation opens with one of at
most a quarter of the budget, and with the turns that fit the history before it; these repeat as
context and are masked. Each assistant turn is a target exactly once: in its own window. So no window
is over the budget, but for a turn that alone is: then history is left out.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts ``&`` becomes
``&amp;`` and ``<|`` becomes ``&lt;|`` (in roles also line feeds ``&nl;``), so no text can hold a
control string and reading back is exact. A window's ``loss`` lists the spans (begin, end exclusive,
in code points of ``formatted``) of its target texts; ``repeated`` is the number of its masked
leading turns.

Prefix sums are made in two levels, over blocks of ``BLOCK`` turn numbers, and windows meet their history
by stretches of the conversation, so one that holds a third of all rows is spread over many tasks; a
window is bounded by its budget.

Defined cases: a null text or role is empty, a null conv_id is a conversation, null turns come first;
rows of equal turn are ordered by role, then text, and repeated rows are turns of their own; an empty
table gives no window; texts of any length stay whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.plans.prefix import prefix_sums

BUDGET = 512
OVERHEAD = 4
BLOCK = 64
START, END = "<|im_start|>", "<|im_end|>"
CLOSE = END + "\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def _rooms(budget: int) -> tuple[int, int, int]:
    """Tokens of a cell, of history and of the system turn."""
    return max(1, budget // 4), budget // 4, budget // 4


def chat_windows(rows: DataFrame, budget: int = BUDGET, target: str = "assistant") -> DataFrame:
    """conv_id, win, formatted, loss, repeated, n_turns (own turns), tokens (with what is repeated) for every window."""
    room, history, most_system = _rooms(budget)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    tokens = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + OVERHEAD
    turns = turns.withColumn("tokens", tokens.cast("long")).withColumn("_b", F.floor(F.col("turn") / BLOCK))
    order = [F.col("turn"), F.col("role"), F.col("text")]
    turns = prefix_sums(turns, ["conv_id"], "_b", order, "tokens", "before", index="at")

    cell = F.floor((F.col("before") + F.col("tokens") - 1) / room)
    alone = (F.floor(F.col("before") / room) < cell) & (F.col("tokens") > room)
    turns = turns.withColumn("win", 2 * cell - alone.cast("long"))
    shown = F.concat(_escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")))
    opening = turns.where((F.col("at") == 0) & (F.col("role") == "system") & (F.col("tokens") <= most_system))
    opening = opening.select(F.col("conv_id").alias("_c"), F.col("tokens").alias("_st"), shown.alias("system"))

    # What of the history each window has room for, from its first turn back.
    spans = turns.groupBy("conv_id", "win").agg(F.min("before").alias("_from"), F.sum("tokens").alias("_own"))
    spans = spans.join(opening.select("_c", "_st"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    left = F.lit(budget) - F.coalesce("_st", F.lit(0)) - F.col("_own")
    spans = spans.select(F.col("conv_id").alias("_c"), F.col("win").alias("_w"), "_from", (F.col("_from") - F.greatest(F.lit(0), F.least(F.lit(history), left))).alias("_back"))
    stretch = lambda c: F.floor(F.col(c) / history).cast("long")
    before = turns.select("conv_id", "at", "role", "text", "tokens", "before", F.explode(F.array(stretch("before"), stretch("before") + 1)).alias("_s"))
    held = spans.where("_back < _from").withColumn("_t", stretch("_from"))
    met = (F.col("before") < F.col("_from")) & (F.col("before") >= F.col("_back"))
    again = before.join(held, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_s") == F.col("_t")) & met)
    again = again.select("conv_id", F.col("_w").alias("win"), "at", "role", "text", "tokens", F.lit(-1).alias("kind"))
    placed = turns.select("conv_id", "win", "at", "role", "text", "tokens", F.lit(0).alias("kind")).unionByName(again)

    is_target = (F.col("kind") == 0) & (F.col("role") == target)
    piece = F.struct("at", "kind", shown.alias("shown"), F.when(is_target, F.char_length(_escape_role(F.col("role"))) + 1).alias("skip"))
    windows = placed.groupBy("conv_id", "win").agg(F.sort_array(F.collect_list(piece)).alias("turns"), F.sum("tokens").alias("tokens"))
    windows = windows.join(opening, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    # History may already hold the system turn.
    needs = F.col("system").isNotNull() & (F.get("turns", F.lit(0))["at"] > 0)
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit(-1).alias("kind"), F.col("system").alias("shown"), F.lit(None).cast("int").alias("skip"))
    whole = F.when(needs, F.concat(F.array(first), F.col("turns"))).otherwise(F.col("turns"))
    windows = windows.withColumns({"turns": whole, "tokens": F.col("tokens") + F.when(needs, F.col("_st")).otherwise(F.lit(0))})

    marked = F.transform("turns", lambda t: F.concat(F.lit(START), t["shown"], F.lit(CLOSE)))
    size = lambda t: F.char_length(t["shown"]) + len(START) + len(CLOSE)
    step = lambda acc, t: F.struct(
        (acc["at"] + size(t)).alias("at"),
        F.when(
            t["skip"].isNotNull(),
            F.concat(acc["loss"], F.array(F.struct((acc["at"] + len(START) + t["skip"]).alias("begin"), (acc["at"] + len(START) + F.char_length(t["shown"])).alias("end")))),
        ).otherwise(acc["loss"]).alias("loss"),
    )
    none = F.array().cast("array<struct<begin:int,end:int>>")
    loss = F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("loss")), step, lambda acc: acc["loss"])
    return windows.select(
        "conv_id",
        "win",
        F.array_join(marked, "").alias("formatted"),
        loss.alias("loss"),
        F.size(F.filter("turns", lambda t: t["kind"] == -1)).alias("repeated"),
        F.size(F.filter("turns", lambda t: t["kind"] == 0)).alias("n_turns"),
        "tokens",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows say, by conversation: turns without the repeated ones, and the
    unescaped text under the loss mask."""
    parts = F.slice(F.split("formatted", r"<\|im_end\|>\n"), F.col("repeated") + 1, F.col("n_turns"))
    said = lambda p: F.substring(p, len(START) + 1, 2_147_483_647)
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["begin"] + 1, s["end"] - s["begin"])))
    window = windows.select(
        "conv_id",
        "win",
        F.transform(parts, lambda p: _read_turn(said(p))).alias("turns"),
        F.array_join(masked, "").alias("loss_text"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    # One string of each window goes to its conversation; the digests need them in order.
    own = F.struct("win", F.array_join("turns", "").alias("turns"), "loss_text", F.size("turns").cast("long").alias("n"), "chars")
    whole = window.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("w"))
    joined = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    total = lambda c: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[c])
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.char_length(joined("loss_text")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss_text"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )


def _read_turn(shown: Column) -> Column:
    """``role \\n text \\n`` of an escaped turn; the first line feed ends the role."""
    role = F.substring_index(shown, "\n", 1)
    text = F.regexp_replace(shown, r"(?s)\A[^\n]*\n", "")
    return F.concat(_unescape_role(role), F.lit("\n"), unescape(text), F.lit("\n"))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts are full of control strings."""
    spark: SparkSession = conversations.sparkSession
    said = CLOSE.rstrip("\n") + START + "assistant ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


_MARKS = len(START) + len(CLOSE) + 1
_ROOM, _HISTORY, _SYSTEM = _rooms(BUDGET)
SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), t AS (
  SELECT *, row_number() OVER o - 1 AS nth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {OVERHEAD} AS tokens,
    length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;')) + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + {_MARKS} AS chars
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM t
), w AS (
  SELECT *, 2 * cell - (before // {_ROOM} < cell AND tokens > {_ROOM})::BIGINT AS win FROM (SELECT *, (before + tokens - 1) // {_ROOM} AS cell FROM p)
), sys AS (SELECT conv_id, tokens, chars FROM w WHERE nth = 0 AND role = 'system' AND tokens <= {_SYSTEM}),
spans AS (SELECT conv_id, win, min(before) AS from_, sum(tokens) AS own FROM w GROUP BY conv_id, win),
wins AS (SELECT s.conv_id, win, from_, from_ - greatest(0, least({_HISTORY}, {BUDGET} - coalesce(sys.tokens, 0) - own)) AS back, sys.chars AS system
  FROM spans s LEFT JOIN sys ON sys.conv_id IS NOT DISTINCT FROM s.conv_id),
shown AS (
  SELECT conv_id, chars FROM w
  UNION ALL SELECT w.conv_id, w.chars FROM w JOIN wins n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND w.before < n.from_ AND w.before >= n.back
  UNION ALL SELECT conv_id, system FROM wins WHERE from_ > 0 AND back > 0 AND system IS NOT NULL
), sizes AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM shown GROUP BY conv_id)
SELECT c.conv_id, c.n_turns, c.turns_sha256, c.loss_chars, c.loss_sha256, s.formatted_chars FROM (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256
  FROM w GROUP BY conv_id
) c JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""

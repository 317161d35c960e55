"""Multi-party perspective rotation with DataFrame functions only.

Every participant of a dialogue gets a rendering in which that one is the assistant, the others are users named
after themselves, and only the assistant's words, with the mark that ends them, are to be learned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_lookup

#: Turns that one row renders, counted in the dialogue's order. A dialogue of more turns goes on in further rows of the same
#: participant, so that no row holds an unbounded one.
TURNS = 1024
#: The speaker whose turns are instructions and who is no participant.
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What begins both marks, and what takes its place in words and names, so that no turn can be forged.
MARK, TAME = "<|im_", "<| im_"


def _tame(text):
    return F.replace(text, F.lit(MARK), F.lit(TAME))


def _head(role, me):
    """Column: what stands before a turn's text in the rendering of ``me``. Line ends in names become spaces."""
    named = F.translate(_tame(role), "\n\r", "  ")
    return F.when(role == SYSTEM, F.lit(f"{OPEN}system\n")).when(role == me, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), named, F.lit("\n")))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", turns_per_row: int = TURNS) -> DataFrame:
    """One row for each conversation, participant and run of ``turns_per_row`` turns.

    Columns: conv_id, speaker, piece, char_start (characters before the piece), n_turns, n_trained, rendered, and
    mask, an array of struct<start, end> of characters of ``rendered`` to learn. Turns stand by turn, role and text, and the piece
    of the nth of them is n div ``turns_per_row``, whatever their numbers: concatenated, a participant's pieces are the whole rendering.
    A null role is the speaker "unknown" and a null text an empty one; a null conv_id
    is a conversation of its own; null turns come first; repeated rows are repeated turns. Marks inside words and names are broken up
    (MARK becomes TAME) and counted as they then are. A conversation with none but system turns has no rows; an
    empty table has none. Other columns play no part.

    Dialogues of one piece are grouped by one shuffle. Only longer ones need their turns' places: these are ranked within blocks of
    ``turns_per_row`` turn numbers, to which the counts of the blocks before are added, so that a very long dialogue is dealt
    over tasks. The lookup of their participants, sums and offsets is stored, counted, and broadcast if it is small.
    """
    rows = _named(turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("unknown")).alias("role"), _tame(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"),
    )).withColumn("block", F.coalesce(F.floor(F.col("turn") / turns_per_row), F.lit(-(1 << 62))))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("key", "block").agg(F.count("*").alias("n"))
    long = cut(counts.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("key"))}).filter(F.col("all") > turns_per_row).select("key", "block", "before"))
    told = join_lookup(rows, long, ["key", "block"], "left")
    own = F.transform(F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r != SYSTEM))), lambda r: F.struct(r.alias("speaker"), F.lit(0).cast("long").alias("char_start")))
    each = _pieces(told.filter("before IS NULL").withColumn("piece", F.lit(0).cast("long"))).withColumn("views", own)
    if long.head(1):
        rank = F.row_number().over(Window.partitionBy("key", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
        placed = cut(told.filter("before IS NOT NULL").withColumn("piece", F.floor((F.col("before") + rank - 1) / turns_per_row).cast("long")).drop("block", "before"))
        each = each.unionByName(join_lookup(_pieces(placed), cut(_views(placed)), ["key", "piece"], entries="views"))
    each = each.select("conv_id", "piece", "turns", F.explode("views").alias("view"))
    parts = F.transform("turns", lambda t: F.struct(_head(t["role"], F.col("view.speaker")).alias("head"), t["text"].alias("text"), (t["role"] == F.col("view.speaker")).alias("mine")))
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["text"]) + len(CLOSE)).cast("long").alias("at"),
            F.when(p["mine"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(p["head"])).cast("long").alias("start"), (s["at"] + F.length(p["head"]) + F.length(p["text"]) + len(CLOSE) - 1).cast("long").alias("end")))))
            .otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    return each.withColumn("parts", parts).select(
        "conv_id", F.col("view.speaker").alias("speaker"), "piece", F.col("view.char_start").alias("char_start"), F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["mine"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE))), "").alias("rendered"), spans.alias("mask"),
    )


def _named(rows: DataFrame) -> DataFrame:
    """With ``key``, a conversation's name that is never null."""
    return rows.withColumn("key", F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("name")))


def _pieces(rows: DataFrame) -> DataFrame:
    """A row for each piece with its turns in order, at most as many as a piece has."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", "text")))
    return rows.groupBy("key", "piece").agg(F.first("conv_id").alias("conv_id"), ordered.alias("turns"))


def _views(placed: DataFrame) -> DataFrame:
    """(key, piece, views): participants and offsets of dialogues that have several pieces, from sums by speaker."""
    counts = placed.groupBy("key", "piece", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    speakers = counts.filter(F.col("role") != SYSTEM).select("key", F.col("role").alias("speaker")).distinct()
    size = F.col("chars") + F.col("n") * (F.length(_head(F.col("role"), F.col("speaker"))) + len(CLOSE))
    sized = counts.join(speakers, "key").groupBy("key", "speaker", "piece").agg(F.sum(size).alias("size"))
    before = Window.partitionBy("key", "speaker").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed_at = sized.withColumn("char_start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    return placed_at.groupBy("key", "piece").agg(F.array_sort(F.collect_list(F.struct("speaker", "char_start"))).alias("views"))


#: op9 in DuckDB's SQL, pieces of TURNS turns too.
SQL = rf"""
WITH turns AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '{MARK}', '{TAME}') AS text FROM conversations),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1) // {TURNS} AS piece FROM turns),
viewed AS (SELECT t.*, s.speaker, CASE WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10) WHEN t.role = s.speaker THEN '<|im_start|>assistant' || chr(10)
    ELSE '<|im_start|>user name=' || translate(replace(t.role, '{MARK}', '{TAME}'), chr(10) || chr(13), '  ') || chr(10) END AS head
  FROM ranked t JOIN (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system') s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (SELECT *, sum(len(head) + len(text) + 11) OVER (PARTITION BY conv_id, speaker, piece ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM viewed),
pieces AS (SELECT conv_id, speaker, CAST(piece AS BIGINT) AS piece, CAST(max(stop) AS BIGINT) AS chars, count(*) AS n_turns, count(*) FILTER (WHERE role = speaker) AS n_trained,
  string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY stop) AS rendered,
  coalesce(string_agg(CAST(stop - len(text) - 11 AS BIGINT) || ':' || CAST(stop - 1 AS BIGINT), ',' ORDER BY stop) FILTER (WHERE role = speaker), '') AS mask
FROM placed GROUP BY conv_id, speaker, piece)
SELECT conv_id, speaker, piece, CAST(coalesce(sum(chars) OVER (PARTITION BY conv_id, speaker ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, n_turns, n_trained, rendered, mask
FROM pieces
"""

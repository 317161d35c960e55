"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per source; each source's target gives its repetition rate; a document comes floor(rate) times
and once more if its seeded hash falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_lookup, native_words

#: Weights that sources take in turn, the share of all words to take, and the most that a source is repeated.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) from (source, size); one row a source.

    Sources in code-point order, null last, take the weights in turn. A target stops at ``most`` times its source's
    size and what is over goes to the others by weight. In the order of size / weight, sources stop one after
    another until the level that the budget left gives to the weight left keeps the next one below its bound; all
    from there on get that level times their weight. The two windows run over one row a source, words already
    summed; a source without words has the target 0.
    """
    # Sums of whole numbers over one row a source; no document passes through these windows.
    everything = Window.orderBy(F.col("source").isNull(), "source")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int")))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("budget", share * F.sum("source_size").over(whole))
        .withColumn("level", (F.col("budget") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("open", F.col("level") * F.col("weight") <= most * F.col("source_size"))
        .withColumn("first", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(whole)["level"])
    )
    target = F.least(F.col("first") * F.col("weight"), most * F.col("source_size"))
    return levels.select("source", "source_size", F.coalesce(target, most * F.col("source_size")).cast("double").alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def chance(key, seed: str = SEED):
    """A number in [0, 1) from the md5 of seed and key: 52 bits, equal wherever md5 is."""
    text = F.concat_ws("\x1f", F.lit(seed), F.coalesce(key.cast("string"), F.lit("\x00")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(rate, key):
    """How often a document comes: floor(rate), and once more with the probability that the fraction gives."""
    return (F.floor(rate) + F.when(chance(key) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def _keyed(rows: DataFrame) -> DataFrame:
    """With the source as two columns that are never null."""
    return rows.withColumns({"key": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})


def with_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **mix) -> DataFrame:
    """(row, size, source_size, target, copies): each row of ``docs`` as a struct, and how often the mix has it.

    The choice hangs on ids, sizes and the seed alone: reruns agree and rows that repeat an id in a source get the same number. A
    null text has size 0; a null source is a source; a null id is one more id. An empty table stays empty. Other columns pass inside
    the struct, so none can clash.
    Words are summed per source before the shuffle. The table of targets is stored, counted, and broadcast only
    if it is small; otherwise the join is shuffled, and AQE splits a hot source.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("source"), native_words(F.col(f"`{text}`")).alias("size"))
    targets = cut(_keyed(source_targets(rows.select("source", "size"), **mix)).drop("source"))
    joined = join_lookup(_keyed(rows).drop("source"), targets, ["key", "none"])
    return joined.select("row", "size", "source_size", "target", copies(F.col("rate"), F.col("id")).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed rows: each row of ``docs`` as often as its source's rate says, with its own columns only.

    Nulls, ties, repeated rows and empty tables are as with_copies says.
    """
    counted = with_copies(docs, **how).filter("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


#: op3 in DuckDB's SQL. The level is the largest that any prefix of stopped sources gives: it falls once the first open one is passed.
SQL = rf"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight FROM totals),
levels AS (SELECT *, (1.5 * (SELECT CAST(sum(source_size) AS BIGINT) FROM totals) - 2.0 * coalesce(CAST(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, source_size / weight AS fill
  FROM ranked WINDOW w AS (ORDER BY source_size / weight, source IS NULL, source)),
first AS (SELECT arg_min(level, row(fill, level)) AS level FROM levels WHERE level * weight <= 2.0 * source_size),
targets AS (SELECT source, source_size, CAST(coalesce(least((SELECT level FROM first) * weight, 2.0 * source_size), 2.0 * source_size) AS DOUBLE) AS target FROM levels),
rated AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('{SEED}' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 13) AS BIGINT) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""

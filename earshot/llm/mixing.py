"""Mixing sources to target weights, with DataFrame operations only.

Tokens are summed for each source, targets follow from the weights by water
filling, and each document comes floor(rate) times plus one more copy with
probability equal to the fraction, decided by a hash of its doc_id and a seed.

Defined cases: a null or empty text has size 0 and is copied like any other of
its source; a null source is a source of its own, last in order; a source whose
documents are all empty has target 0 and rate 0; rows that repeat a doc_id get
the same decision; an empty table gives an empty result; other columns are
untouched whatever their names; ``with_copies`` adds columns that begin with _mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import join_even, materialize, packed

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: The words that count as tokens here: runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """Per source of ``sizes(_source, _mix_size)``: _source, _mix_source_size and _mix_target.

    The rank of a source in code-point order comes from range partitions and
    their counts, so no task sees all sources.  Rounds of one small aggregate
    each find the sources that stop at their cap.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("_source").agg(F.sum("_mix_size").alias("_mix_source_size"))
    ordered = totals.repartitionByRange(F.col("_source").asc_nulls_last()).sortWithinPartitions(F.col("_source").asc_nulls_last())
    ordered = ordered.withColumn("_at", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumn("_part", F.shiftright("_at", 33)), "sources")
    parts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range partition
    parts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    rank = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_ahead")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    table = ordered.join(parts, "_part").select("_source", "_mix_source_size", weight.cast("long").alias("_weight"), (F.col("_mix_source_size") * most).alias("_cap"))
    table = materialize(table, "weights")
    whole = table.agg(F.sum("_mix_source_size")).first()[0] or 0

    def level(under: Column) -> tuple[int, int]:
        row = table.agg(F.sum(F.when(under, F.col("_cap"))), F.sum(F.when(~under, F.col("_weight")))).first()
        return row[0] or 0, row[1] or 0

    stopped, (capped, open_weight) = F.lit(False), level(F.lit(False))
    while open_weight:
        share = F.lit(float(whole - capped)) * F.col("_weight") / F.lit(float(open_weight))
        above = stopped | (F.col("_cap") < share)
        after = level(above)
        if after == (capped, open_weight):
            break
        stopped, (capped, open_weight) = above, after
    share = F.lit(float(whole - capped)) * F.col("_weight") / F.lit(float(open_weight or 1))
    return table.select("_source", "_mix_source_size", F.when(stopped, F.col("_cap").cast("double")).otherwise(share).alias("_mix_target"))


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """``docs`` with _mix_size, _mix_source_size, _mix_target and _mix_copies (how often the mix takes the document)."""
    sized = docs.withColumn("_mix_size", word_count(F.col("text")))
    targets = source_targets(sized.select(F.col("source").alias("_source"), "_mix_size"), weights, most)
    # A hot source is split by AQE; sources are few as a rule, and then Catalyst broadcasts them by their size.
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    targets = targets.withColumn("_mix_key", F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n"))).drop("_source")
    rows = join_even(sized.withColumn("_mix_key", key), targets, ["_mix_key"], merge=False)
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return rows.withColumn("_mix_copies", copies.cast("long")).drop("_mix_key")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of ``docs``."""
    rows = packed(docs, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source"))
    taken = with_copies(rows, weights, most, seed).filter(F.col("_mix_copies") > 0)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select("_row.*")

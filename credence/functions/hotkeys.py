"""Per-key results for keys of any size.

A key may hold a large share of all rows, so no function here brings the rows of one key together
in one task.  Rows are spread over (key, salt), summarised per (key, salt), and only those small
summaries (at most ``salts`` per key) meet again per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.session import cut_lineage

SALTS = 32


def salt_of(*spread_by: str, salts: int = SALTS) -> Column:
    """Salt of a row, never NULL."""
    return F.coalesce(F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"), F.lit(0))


def with_key_summary(
    rows: DataFrame,
    keys: list[str],
    spread_by: list[str],
    partial: dict[str, Column],
    total: dict[str, Column],
    keep: Column | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Every row with the summary of its key.

    ``partial`` are aggregates over rows, ``total`` aggregates over the partial columns.  Rows go
    through one exchange on (key, salt); both the summary and the join back read that exchange.
    Keys whose summary fails ``keep`` are not sent back; their rows get NULLs.  Rows with a NULL
    key are kept with NULLs.  Give keys that can not be NULL (coalesce) to let both reads share one
    exchange: for nullable keys the optimizer filters one of them first.
    """
    salted = rows.withColumn("_salt", salt_of(*spread_by, salts=salts))
    salted = salted.repartition(*keys, "_salt")
    parts = salted.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    per_key = Window.partitionBy(*keys)
    sums = parts.select(*keys, "_salt", *[c.over(per_key).alias(n) for n, c in total.items()])
    if keep is not None:
        sums = sums.where(keep)
    return salted.join(sums, [*keys, "_salt"], "left").drop("_salt")


def left_join_spread(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """``parent LEFT JOIN child`` when one parent key may own a large share of the children.

    A left join can only be split on its left side, so matched rows come from an inner join, which
    adaptive execution splits on either side, and childless parents from an anti join on the
    distinct keys.
    """
    matched = parent.join(child, F.col(parent_key) == F.col(child_key), "inner")
    owners = child.select(F.col(child_key).alias("_owner")).where("_owner is not null").distinct()
    childless = parent.join(owners, F.col(parent_key) == F.col("_owner"), "left_anti")
    return matched.unionByName(childless, allowMissingColumns=True)


def numbered(rows: DataFrame, order: list[Column], name: str = "row_no", by: list[str] | None = None) -> DataFrame:
    """Running number from 1 in a total order, over the whole table or within ``by``.

    Rows are range-partitioned on the order and sorted inside each range, where a row's place is its
    local number; it is shifted by the number of rows in earlier ranges.  That is one exchange of the
    rows; only one count per range (and ``by`` value) is brought together.  ``order`` must be unique,
    else ties are numbered arbitrarily.
    """
    by = by or []
    keys = [*[F.col(b) for b in by], *order]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of the row in its partition
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_range": F.spark_partition_id(), "_place": place})
    # Range bounds are sampled: fix the placement once, so that both reads below see the same ranges.
    ranged = cut_lineage(ranged)
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    if not by:
        offsets = F.broadcast(offsets)  # one row per shuffle partition
    joined = ranged.join(offsets, [*by, "_range"])
    return joined.withColumn(name, (F.col("_place") + F.col("_shift") + 1).cast("bigint")).drop("_range", "_place", "_shift")


def order_number(at: Column, kind: str) -> Column:
    """A date, time or whole number as a whole number of the same order, whatever the session's time zone; NULL stays NULL."""
    if kind in ("timestamp", "timestamp_ntz"):
        if kind == "timestamp":
            return F.unix_micros(at)
        seconds = F.unix_date(at.cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return F.unix_date(at).cast("long") if kind == "date" else at.cast("long")


def latest_per_key(rows: DataFrame, key: str, at: str, tie: str | None = None) -> DataFrame:
    """The row with the greatest (``at``, ``tie``) per key, NULL before all others; the pair must be unique within a key, ``at`` within 62 bits (any time is).

    Both are packed into one number, so the maximum is kept in fixed-width hash buffers and a key of any size is
    reduced before the exchange; nothing is sorted.  The rows are then picked by a hash join on (key, number), which
    deals a large key over many tasks.  Rows without a key are left out.
    """
    kinds = dict(rows.dtypes)
    number = lambda value: F.lit(str(value)).cast("decimal(38,0)")
    wide = lambda c, none: F.coalesce(order_number(F.col(c), kinds[c]).cast("decimal(38,0)"), number(none))
    low = wide(tie, -(1 << 63)) if tie else number(0)
    packed = rows.where(F.col(key).isNotNull()).withColumn("_order", (wide(at, -(1 << 62)) * number(1 << 64) + (low + number(1 << 63))).cast("decimal(38,0)"))
    last = packed.groupBy(F.col(key)).agg(F.max("_order").alias("_order"))
    return packed.join(last.hint("shuffle_hash"), [key, "_order"], "left_semi").select(rows.columns)

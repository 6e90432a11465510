"""Running totals and ordered folds that never gather a group.

A log is cut into blocks of consecutive sequence numbers. A block of one key has
a bounded number of rows, so it can be sorted in one task; blocks are then
combined, block totals by block totals, until one value per key is left. A key
that holds a third of the log is spread over its blocks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 12  # rows of a key in one window block: at most 4096
FOLD_BITS = [16, 16, 16, 15]  # rows or blocks folded in one group at each level, 63 bits in all


def running(df: DataFrame, keys: list[str], seq: str, sums: dict[str, Column],
            tops: dict[str, Column] | None = None) -> DataFrame:
    """Running sums and maxima per key in the order of ``seq``, this row included.

    ``seq`` is a non-negative bigint that is unique within a key. Sums and maxima
    inside a block come from a window over the block; what stands before a block
    comes from windows over block totals, in two steps so that no window holds
    more than the totals of 4096 blocks, or of the super-blocks of one key.
    """
    tops = tops or {}
    block, upper = F.shiftright(F.col(seq), BLOCK_BITS), F.shiftright(F.col("_block"), BLOCK_BITS)
    rows = df.withColumns(
        {f"_s_{n}": c.cast("bigint") for n, c in sums.items()} | {f"_t_{n}": c for n, c in tops.items()}
        | {"_block": block})
    names = [f"_s_{n}" for n in sums] + [f"_t_{n}" for n in tops]

    def fold(name):
        return F.sum if name.startswith("_s_") else F.max

    def before(table, part, order):
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return table.select(*part, order, *[fold(n)(n).over(w).alias(f"{n}_{order}") for n in names])

    totals = rows.groupBy(*keys, "_block").agg(*[fold(n)(n).alias(n) for n in names])
    totals = totals.withColumn("_upper", upper)
    supers = totals.groupBy(*keys, "_upper").agg(*[fold(n)(n).alias(n) for n in names])
    offsets = null_safe_join(
        before(totals, [*keys, "_upper"], "_block"), before(supers, keys, "_upper"),
        [*keys, "_upper"]).drop("_upper")
    inside = Window.partitionBy(*keys, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"{n}_in": fold(n)(n).over(inside) for n in names})
    out = null_safe_join(out, offsets, [*keys, "_block"])

    def total(n):
        name = f"_s_{n}"
        return sum((F.coalesce(f"{name}{end}", F.lit(0)) for end in ("_in", "__block", "__upper")), F.lit(0))

    def top(n):
        return F.greatest(*[f"_t_{n}{end}" for end in ("_in", "__block", "__upper")])

    return out.withColumns({n: total(n) for n in sums} | {n: top(n) for n in tops}).select(
        *df.columns, *sums, *tops)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; a null key meets a null key."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                         *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, same).drop(*[f"_r_{k}" for k in keys])


def ordered_fold(df: DataFrame, keys: list[str], seq: str, unit: Column, combine) -> DataFrame:
    """Fold an associative operation over the rows of each key in ``seq`` order.

    ``unit`` is the value of one row and ``combine(left, right)`` joins the values
    of two neighbouring stretches into one of the same type. Returns the keys and
    ``folded``.
    """
    rows = df.select(*keys, F.col(seq).alias("_seq"), unit.alias("_v"))
    for bits in FOLD_BITS:
        rows = rows.groupBy(*keys, F.shiftright("_seq", bits).alias("_seq_up")).agg(
            F.array_sort(F.collect_list(F.struct("_seq", "_v"))).alias("_list")
        ).select(
            *keys, F.col("_seq_up").alias("_seq"),
            F.aggregate(
                F.slice(F.col("_list"), 2, 1 << bits), F.get("_list", 0)["_v"],
                lambda acc, x: combine(acc, x["_v"]),
            ).alias("_v"),
        )
    return rows.select(*keys, F.col("_v").alias("folded"))

"""One-dimensional density clustering with windows: sort, gaps, islands; within groups, or over blocks of large ones."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a block in neighbourhoods; a block also sees two of them on each side.
BLOCK = 32


def density_1d(df: DataFrame, keys: list[str], x: str, order: str, eps: float, min_samples: int, out: str, weight: str | None = None) -> DataFrame:
    """df with out, the number of each row's cluster from the left within keys, -1 for noise.

    Points within eps are neighbours, a point with min_samples of them (itself included) is a core point, core points
    that are neighbours share a cluster. Another point joins a neighbouring core point's cluster; between two, the one
    whose first core point comes first by order wins. Rows with a null x are dropped. weight: a column that says how many
    points a row stands for, where each x has one row within keys.
    """
    points = F.sum(weight) if weight else F.count(F.lit(1))
    df = df.filter(F.col(x).isNotNull())
    line = Window.partitionBy(*keys).orderBy(x, order)
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    if min_samples <= 2:
        new = F.coalesce((F.col(x) - F.lag(x).over(line) > eps).cast("int"), F.lit(0))
        df = df.withColumn("_new", new).withColumn(out, F.sum("_new").over(so_far).cast("int"))
        if min_samples == 2:
            own = Window.partitionBy(*keys, out)
            df = df.withColumn("_n", points.over(own))
            kept = df.withColumn("_new", F.when((F.col("_n") > 1) & (F.coalesce(F.lag(out).over(line), F.lit(-1)) != F.col(out)), 1).otherwise(0))
            df = kept.withColumn(out, F.when(F.col("_n") > 1, F.sum("_new").over(so_far).cast("int") - 1).otherwise(-1)).drop("_n")
        return df.drop("_new")
    by = ", ".join(keys)
    near = f"{f'sum({weight})' if weight else 'count(*)'} over (partition by {by} order by {x} range between {eps}D preceding and {eps}D following) >= {min_samples}"
    df = df.withColumn("_core", F.expr(near)).withColumn("_cx", F.when(F.col("_core"), F.col(x)))
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(1, Window.unboundedFollowing)
    gap = F.col(x) - F.last("_cx", True).over(before)
    df = df.withColumn("_new", F.when(F.col("_core") & (gap.isNull() | (gap > eps)), 1).otherwise(0))
    df = df.withColumn("_c", F.when(F.col("_core"), F.sum("_new").over(so_far) - 1))
    df = df.withColumn("_first", F.when(F.col("_core"), F.min(F.when(F.col("_core"), F.col(order))).over(Window.partitionBy(*keys, "_c"))))
    point = F.when(F.col("_core"), F.struct(F.col(x).alias("x"), "_c", "_first"))
    df = df.withColumn("_p", point)
    df = df.withColumn("_l", F.last("_p", True).over(before)).withColumn("_r", F.first("_p", True).over(after))
    left = F.when(F.col(x) - F.col("_l.x") <= eps, F.struct(F.col("_l._first").alias("f"), F.col("_l._c").alias("c")))
    right = F.when(F.col("_r.x") - F.col(x) <= eps, F.struct(F.col("_r._first").alias("f"), F.col("_r._c").alias("c")))
    label = F.coalesce(F.col("_c"), F.least(left, right)["c"], F.lit(-1))
    return df.withColumn(out, label.cast("int")).drop("_core", "_cx", "_new", "_c", "_first", "_p", "_l", "_r")


def density_blocks(df: DataFrame, keys: list[str], x: str, order: str, eps: float, min_samples: int, out: str, block: int = BLOCK) -> DataFrame:
    """What density_1d gives, for few keys with very many rows each: equal values are one row with their count, and a
    window holds one block of a key's values with all that its neighbourhoods need, not the whole key.

    Points within eps of a block have all their neighbours there, so core points and starts of clusters are known within
    a block; a cluster's number is that of the starts in earlier blocks, summed per block, and those before it in its own.
    """
    values = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"))
    number, reach = (lambda at: F.floor(at / F.lit(eps * block))), 2 * eps * (1 + 1e-9)
    seen = F.array_distinct(F.array(number(F.col(x) - reach), number(F.col(x)), number(F.col(x) + reach)))
    each = values.withColumn("_b", number(F.col(x))).withColumn("_at", F.explode(seen))
    line = Window.partitionBy(*keys, "_at").orderBy(x)
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    by = ", ".join([*keys, "_at"])
    each = each.withColumn("_core", F.expr(f"sum(_n) over (partition by {by} order by {x} range between {eps}D preceding and {eps}D following) >= {min_samples}"))
    each = each.withColumn("_cx", F.when(F.col("_core"), F.col(x)))
    gap = F.col(x) - F.last("_cx", True).over(before)
    each = each.withColumn("_new", F.when(F.col("_core") & (F.col("_b") >= F.col("_at")) & (gap.isNull() | (gap > eps)), 1).otherwise(0))
    starts = each.filter("_b = _at").groupBy(*keys, "_at").agg(F.sum("_new").alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_base", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")
    each = same(each, starts, [*keys, "_at"])
    own = F.when(F.col("_core"), F.col("_base") + F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    each = each.withColumn("_c", own).withColumn("_p", F.when(F.col("_core"), F.struct(F.col(x).alias("x"), "_c")))
    each = each.withColumn("_l", F.last("_p", True).over(before)).withColumn("_r", F.first("_p", True).over(after)).filter("_b = _at")
    left, right = F.when(F.col(x) - F.col("_l.x") <= eps, F.col("_l._c")), F.when(F.col("_r.x") - F.col(x) <= eps, F.col("_r._c"))
    found = each.select(*keys, x, "_o", "_c", F.coalesce("_c", left, right).alias("_left"), F.coalesce("_c", right, left).alias("_right"))
    plain = found.filter(F.col("_left").isNull() | (F.col("_left") == F.col("_right"))).select(*keys, x, F.coalesce("_left", F.lit(-1)).alias(out))
    if min_samples > 2:  # else a point with a neighbour is a core point
        first = found.filter(F.col("_c").isNotNull()).groupBy(*keys, "_c").agg(F.min("_o").alias("_f"))
        torn = found.filter("_left != _right").select(*keys, x, F.explode(F.array("_left", "_right")).alias("_c"))
        torn = same(torn, first, [*keys, "_c"]).groupBy(*keys, x).agg(F.min(F.struct("_f", "_c")).alias("_m"))
        plain = plain.unionByName(torn.select(*keys, x, F.col("_m._c").alias(out)))
    return same(df.drop(out), plain.withColumn(out, F.col(out).cast("int")), [*keys, x])


def same(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """The rows of both with equal names; nulls are equal."""
    right = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    return left.join(right, reduce(and_, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names])).drop(*[f"_r_{n}" for n in names])

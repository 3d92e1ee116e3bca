"""Choice of forget classes, and forget/retain and train/test splits, by seeded order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probeforge.operators.sampling import seeded
from probeforge.schema import ConstraintError


def eligible_classes(df: DataFrame, cls: str, least: int) -> DataFrame:
    return df.groupBy(cls).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(cls)


def _enough(classes: DataFrame, k: int) -> None:
    have = classes.count()
    if have < k:
        raise ConstraintError("classes", [f"{have} are eligible, {k} are asked for"])


def random_k(classes: DataFrame, cls: str, k: int, seed: int) -> DataFrame:
    """k classes by seeded order; too few raise."""
    _enough(classes, k)
    return classes.orderBy(seeded(seed, cls), cls).limit(k)


def balanced_allocation(classes: DataFrame, superclass: str, k: int, seed: int) -> DataFrame:
    """(superclass, capacity, allocated): k classes dealt to superclasses as evenly as their numbers of classes allow; too few raise.

    Water-filling: with capacities in order and their prefix sums, the level is the share of what smaller superclasses leave, at the first
    superclass that has more than it; what the level leaves over goes to superclasses above it in seeded order. A row a superclass.
    """
    _enough(classes, k)
    sizes = classes.groupBy(superclass).agg(F.count("*").alias("capacity"))
    order = Window.orderBy("capacity", superclass)
    smaller = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upward = F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1
    share = F.floor((F.lit(k) - smaller) / upward)
    level = F.min(F.when(F.col("share") < F.col("capacity"), F.struct("nth", "share"))).over(Window.partitionBy())["share"]
    filled = sizes.withColumns({"share": share, "nth": F.row_number().over(order)}).withColumn("level", F.coalesce(level, F.max("capacity").over(Window.partitionBy())))
    filled = filled.withColumns({"base": F.least("capacity", "level"), "above": F.col("capacity") > F.col("level")})
    left = F.lit(k) - F.sum("base").over(Window.partitionBy())
    turn = F.row_number().over(Window.partitionBy("above").orderBy(seeded(seed, superclass), superclass))
    out = filled.withColumns({"left": left, "turn": turn})
    return out.select(superclass, "capacity", (F.col("base") + (F.col("above") & (F.col("turn") <= F.col("left"))).cast("long")).alias("allocated"))


def balanced_k(classes: DataFrame, cls: str, superclass: str, k: int, seed: int) -> DataFrame:
    """k classes, as evenly over superclasses as they allow: of each, in seeded order, as many as balanced_allocation says."""
    turn = F.row_number().over(Window.partitionBy(superclass).orderBy(seeded(seed, cls), cls))
    dealt = balanced_allocation(classes, superclass, k, seed).select(F.col(superclass).alias("dealt_super"), "allocated")
    out = classes.withColumn("turn", turn).join(dealt, F.col(superclass).eqNullSafe(F.col("dealt_super")))
    return out.where("turn <= allocated").select(cls, superclass)


def split_forget(df: DataFrame, forget: DataFrame, cls: str, item: str, n_train: int, n_test: int, seed: int) -> DataFrame:
    """Rows of forget classes with their split: of each class, in seeded order, test first, then train."""
    rn = F.row_number().over(Window.partitionBy(cls).orderBy(seeded(seed, item), item))
    out = df.join(forget.select(cls), cls, "left_semi").withColumn("rn", rn)
    return out.withColumn("split", F.when(F.col("rn") <= n_test, "test_forget").when(F.col("rn") <= n_test + n_train, "train_forget")).where("split is not null").drop("rn")


def split_retain(df: DataFrame, forget: DataFrame, cls: str, item: str, n_train: int, n_test: int, seed: int) -> DataFrame:
    """The first rows in seeded order of the other classes: train, then test.

    The first n_train + n_test rows are taken from each task's own first ones, so only these are ordered together.
    """
    pool = df.join(forget.select(cls), cls, "left_anti")
    first = pool.orderBy(seeded(seed, item), item).limit(n_train + n_test)
    rn = F.row_number().over(Window.orderBy(seeded(seed, item), item))
    return first.withColumn("rn", rn).withColumn("split", F.when(F.col("rn") <= n_train, "train_retain").otherwise("test_retain")).drop("rn")


def split_single(df: DataFrame, target: str, cls: str, item: str, n_train: int | None, n_test: int, seed: int) -> DataFrame:
    """A single class: train first, then test; without n_train all but n_test train."""
    pool = df.where(F.col(cls) == target)
    rn = F.row_number().over(Window.partitionBy(cls).orderBy(seeded(seed, item), item))
    size = F.count("*").over(Window.partitionBy(cls))
    train = F.lit(n_train) if n_train is not None else F.greatest(size - n_test, F.lit(0))
    return pool.withColumns({"rn": rn, "t": train}).withColumn("split", F.when(F.col("rn") <= F.col("t"), "train_forget").when(F.col("rn") <= F.col("t") + n_test, "test_forget")).where("split is not null").drop("rn", "t")


def class_level_split(classes: DataFrame, cls: str, ratios: dict[str, float], seed: int) -> DataFrame:
    """Whole classes dealt to splits by ratios (whole numbers, rounded down; the last split takes the rest). Classes are a dimension."""
    total = classes.count()
    rn = F.row_number().over(Window.orderBy(seeded(seed, cls), cls))
    name, upto, out = list(ratios)[-1], 0, None
    for k, r in list(ratios.items())[:-1]:
        upto += int(total * r)
        out = F.when(rn <= upto, k) if out is None else out.when(rn <= upto, k)
    return classes.withColumn("split", out.otherwise(name) if out is not None else F.lit(name))


def overlap(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that more than one split has, and which."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count("*").alias("n")).where(F.size("splits") > 1)


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def class_leakage(df: DataFrame, cls: str, split: str = "split") -> DataFrame:
    """For each pair of splits, how many classes both have."""
    have = df.select(split, cls).distinct()
    a, b = have.select(F.col(split).alias("s1"), cls), have.select(F.col(split).alias("s2"), cls)
    return a.join(b, cls).where("s1 < s2").groupBy("s1", "s2").agg(F.count("*").alias("shared"))

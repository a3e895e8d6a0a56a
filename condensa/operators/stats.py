"""Statistics of groups of records: what is typical, what stands out, which rows to keep.

All operators work on any table; ``by`` are the columns of a group, ``order`` those that fix the order within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.config import CRUSH


def _by(by: list[str] | str) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def field_stats(df: DataFrame, by: list[str] | str, field: str) -> DataFrame:
    """Count, distinct values, extent, mean, variance and quartiles of a numeric field, by group."""
    x = F.col(field).cast("double")
    return df.groupBy(*_by(by)).agg(
        F.count(field).alias("n"), F.count_distinct(field).alias("unique_count"),
        (F.count_distinct(field) / F.count(field)).alias("unique_ratio"), F.min(x).alias("min_val"), F.max(x).alias("max_val"),
        F.avg(x).alias("mean_val"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("stdev"),
        F.percentile(x, F.lit(0.25)).alias("p25"), F.percentile(x, F.lit(0.75)).alias("p75"),
    )


def value_counts(df: DataFrame, by: list[str] | str, field: str) -> DataFrame:
    return df.where(F.col(field).isNotNull()).groupBy(*_by(by), F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def rare_values(df: DataFrame, by: list[str] | str, field: str) -> DataFrame:
    """Values beyond the few that cover most rows, of fields with 2 to 50 values: by group, value and n.

    Nulls are counted as the value ``__none__``, but not among the 2 to 50. Values are counted before they are ranked,
    so what meets in one place is the few values of a field, not those of an id.
    """
    keys = _by(by)
    value = F.coalesce(F.col(field).cast("string"), F.lit("__none__"))
    counts = df.groupBy(*keys, value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count(field).alias("own"))
    sizes = counts.groupBy(*keys).agg(F.count_if(F.col("own") > 0).alias("kinds"), F.sum("n").alias("rows")).where(F.col("kinds").between(2, CRUSH.rare_most_values))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(w.orderBy(F.desc("n"), "value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = counts.join(sizes, keys).select(*keys, "value", "n", (before < F.ceil(F.lit(CRUSH.rare_cover) * F.col("rows"))).alias("top"))
    marked = marked.withColumn("k", F.sum(F.col("top").cast("int")).over(w))
    return marked.where((F.col("k") <= CRUSH.rare_top) & ~F.col("top")).select(*keys, "value", "n")


def rare_fields(df: DataFrame, by: list[str] | str, keys: Column) -> DataFrame:
    """Names (an array column) that fewer than a fifth of a group's rows have: by group, field and n."""
    g = _by(by)
    sizes = df.groupBy(*g).agg(F.count(F.lit(1)).alias("rows"))
    names = df.select(*g, F.explode(keys).alias("field")).groupBy(*g, "field").agg(F.count(F.lit(1)).alias("n"))
    return names.join(sizes, g).where((F.col("rows") >= CRUSH.min_items) & (F.col("n") < CRUSH.structural_share * F.col("rows"))).select(*g, "field", "n", "rows")


def sigma_outliers(df: DataFrame, by: list[str] | str, field: str) -> DataFrame:
    """Rows whose number is more than two sample standard deviations from the mean of their group."""
    keys, x = _by(by), F.col(field).cast("double")
    # the means are one row a group: joined back, so that no group has to pass through one task
    m = df.groupBy(*keys).agg(F.avg(x).alias("__mean"), F.stddev_samp(x).alias("__sd"))
    far = (F.col("__sd") > 0) & (F.abs(x - F.col("__mean")) > CRUSH.sigmas * F.col("__sd"))
    return df.join(m, keys).where(far).drop("__mean", "__sd")


def change_points(df: DataFrame, by: list[str] | str, order: str, field: str) -> DataFrame:
    """Rows at which a series steps unlike its other steps; series of more than 10 rows."""
    keys, w = _by(by), Window.partitionBy(*_by(by)).orderBy(order)
    steps = df.withColumns({"__step": F.col(field).cast("double") - F.lag(F.col(field).cast("double")).over(w)})
    m = steps.groupBy(*keys).agg(F.avg("__step").alias("__mean"), F.stddev_samp("__step").alias("__sd"), F.count(F.lit(1)).alias("__n"))
    far = (F.col("__n") > 10) & (F.col("__sd") > 0) & (F.abs(F.col("__step") - F.col("__mean")) > CRUSH.sigmas * F.col("__sd"))
    return steps.join(m, keys).where(far).withColumn("step", F.col("__step")).drop("__step", "__mean", "__sd", "__n")


def window_jumps(df: DataFrame, by: list[str] | str, order: str, field: str, width: int = 5) -> DataFrame:
    """Rows at which the means of the ``width`` rows before and from there on differ by more than two deviations."""
    keys, w = _by(by), Window.partitionBy(*_by(by)).orderBy(order)
    x = F.col(field).cast("double")
    sides = df.withColumns(
        {
            "__left": F.avg(x).over(w.rowsBetween(-width, -1)), "__right": F.avg(x).over(w.rowsBetween(0, width - 1)),
            "__pos": F.row_number().over(w) - 1,
        }
    )
    m = df.groupBy(*keys).agg(F.stddev_samp(x).alias("__sd"), F.count(F.lit(1)).alias("__n"))
    inside = (F.col("__n") > 10) & F.col("__pos").between(width, F.col("__n") - width - 1)
    jump = inside & (F.col("__sd") > 0) & (F.abs(F.col("__left") - F.col("__right")) > 2 * F.col("__sd"))
    return sides.join(m, keys).where(jump).drop("__left", "__right", "__pos", "__sd", "__n")


def around(df: DataFrame, by: list[str] | str, order: str, flag: Column, before: int, after: int | None = None) -> Column:
    """True for rows near a flagged one, by position in the group."""
    after = before if after is None else after
    w = Window.partitionBy(*_by(by)).orderBy(order).rowsBetween(-after, before)
    return F.max(flag.cast("int")).over(w) > 0


def top_n(df: DataFrame, by: list[str] | str, score: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*_by(by)).orderBy(F.desc(score), F.col(order))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cluster_sample(df: DataFrame, by: list[str] | str, message: str, order: str, each: int = 2, prefix: int = 50) -> DataFrame:
    """The first rows of each cluster of messages that begin alike."""
    keys = _by(by)
    head = F.substring(message, 1, prefix)
    # by the head itself: of some 100,000 heads, two share the eight digits that name a cluster
    w = Window.partitionBy(*keys, head).orderBy(order)
    return df.withColumn("cluster", F.substring(F.sha2(head, 256), 1, 8)).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= each)


def first_copies(df: DataFrame, by: list[str] | str, content: Column, order: str) -> DataFrame:
    """The first row of each content, and the number of its copies."""
    keys = _by(by)
    hashed = df.withColumn("content_hash", F.substring(F.sha2(content, 256), 1, 16))
    first = hashed.groupBy(*keys, "content_hash").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))
    return hashed.drop("copies").join(first, [*keys, "content_hash", order])


def histogram(df: DataFrame, by: list[str] | str, field: str, most: int = 10) -> DataFrame:
    """Share of each value (as ``c/total``) of a field that all rows have, if it has few values."""
    keys = _by(by)
    counts = value_counts(df, keys, field)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    few = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).join(sizes, keys).where((F.col("kinds") <= most) & (F.col("total") == F.col("rows")))
    share = F.concat(F.col("n").cast("string"), F.lit("/"), F.col("total").cast("string"))
    return counts.join(few, keys).select(*keys, "value", share.alias("share"))


def budget(n: Column) -> Column:
    """How many of n rows to keep."""
    return F.when(n <= 8, n).otherwise(F.least(F.greatest(F.floor(n / 4), F.lit(3)), F.lit(CRUSH.max_items)))


def ends(n: Column) -> tuple[Column, Column, Column]:
    """Budget, and how many of it from the front and the back."""
    k = budget(n)
    first = F.least(k, F.greatest(F.lit(1), F.floor(k * F.lit(CRUSH.first_share) + 0.5)))
    return k, first, F.least(F.greatest(F.lit(1), F.floor(k * F.lit(CRUSH.last_share) + 0.5)), k - first)


def recommended(score: Column, changes: Column, message: Column, constant: Column, errors: Column, outliers: Column, low_card: Column) -> Column:
    """Name of the strategy, from what was found in an array."""
    signal = score | constant | errors | outliers
    return F.when(~signal, "skip").when(score, "top_n").when(changes, "time_series").when(message & low_card, "cluster").otherwise("smart_sample")


def json_type(value: Column) -> Column:
    """Type tag of a JSON value given as text."""
    return (
        F.when(value.isNull() | (value == "null"), "null").when(value.isin("true", "false"), "bool")
        .when(value.rlike(r"^-?\d+$"), "int").when(value.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), "float")
        .when(value.rlike(r"^\s*[{\[]"), "json").otherwise("string")
    )


def key_profile(df: DataFrame, by: list[str] | str, json: str) -> DataFrame:
    """By group and key of JSON objects: n, kinds of values, whether all rows have it, distinct values, inferred type."""
    keys = _by(by)
    entries = df.select(*keys, F.explode(F.from_json(json, "map<string,string>")).alias("field", "value"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    tags = entries.withColumn("tag", json_type(F.col("value")))
    out = tags.groupBy(*keys, "field").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("unique_count"),
        F.count_distinct(F.when(F.col("tag") != "null", F.col("tag"))).alias("kinds"), F.min(F.when(F.col("tag") != "null", F.col("tag"))).alias("one"),
        F.count_if(F.col("tag") == "null").alias("nulls"),
    )
    joined = out.join(sizes, keys)
    tag = F.when(F.col("kinds") == 0, "string").when(F.col("kinds") == 1, F.col("one")).otherwise("json")
    return joined.select(*keys, "field", "n", "unique_count", tag.alias("type"), ((F.col("n") < F.col("rows")) | (F.col("nulls") > 0)).alias("nullable"))


def discriminators(df: DataFrame, by: list[str] | str, fields: list[str]) -> DataFrame:
    """Of string fields without nulls that have 2 to 8 values, at most 0.7 for each row, that with most values."""
    keys = _by(by)
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.struct(F.count(f).alias("n"), F.count_distinct(f).alias("kinds"), F.lit(f).alias("field")).alias(f) for f in fields])
    each = wide.select(*keys, "rows", F.explode(F.array(*fields)).alias("f")).select(*keys, "rows", "f.*")
    fit = each.where((F.col("n") == F.col("rows")) & F.col("kinds").between(2, 8) & (F.col("kinds") / F.col("rows") <= 0.7))
    w = Window.partitionBy(*keys).orderBy(F.desc("kinds"), "field")
    return fit.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*keys, "field", "kinds")

"""Rating prediction: item neighbourhoods, boosted trees over features, a weighted hybrid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.plans.lineage import keep, spread

#: Similarity by the ratio of two items' means where co-raters define none: bounds, inclusive, from the middle outwards.
LADDER = [(0.9, 1.1, 0.9), (0.8, 1.2, 0.7), (0.7, 1.3, 0.5), (0.6, 1.4, 0.3)]
FLAT = 1e-9


def one_rating(ratings: DataFrame) -> DataFrame:
    """(user, item, rating): several ratings of one pair count as their average."""
    return ratings.groupBy("user", "item").agg(F.avg("rating").alias("rating"))


def means(ratings: DataFrame, key: str) -> DataFrame:
    return ratings.groupBy(key).agg(F.avg("rating").alias(f"{key}_mean"))


def centred(ratings: DataFrame) -> DataFrame:
    """Ratings less their user's mean."""
    return ratings.join(means(ratings, "user"), "user").select("user", "item", (F.col("rating") - F.col("user_mean")).alias("deviation"))


def ladder(ratio: Column) -> Column:
    out = F.when((ratio >= LADDER[0][0]) & (ratio <= LADDER[0][1]), LADDER[0][2])
    for low, high, value in LADDER[1:]:
        out = out.when((ratio >= low) & (ratio <= high), value)
    return out.otherwise(0.1)


def pearson(deviations: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, n, similarity): over users who rated both; null where either side doesn't vary.

    With pairs (a, b) only those are computed: pairs meet the ratings of a, then of b.
    """
    left = spread(deviations, "item").select("user", F.col("item").alias("a"), F.col("deviation").alias("x"))
    right = deviations.select("user", F.col("item").alias("b"), F.col("deviation").alias("y"))
    both = left.join(right, "user").filter("a < b") if pairs is None else spread(pairs, "a", "b").join(left, "a").join(right, ["user", "b"])
    x, y = F.col("x"), F.col("y")
    sums = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))
    vx, vy = F.col("xx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")
    return sums.select("a", "b", "n", F.when((vx > FLAT) & (vy > FLAT), cov / F.sqrt(vx * vy)).alias("similarity"))


def item_cf(ratings: DataFrame, queries: DataFrame, neighbours: int = 18) -> DataFrame:
    """(user, item) queries -> (user, item, prediction).

    Unknown user or item: the other's mean, or the mean of all.  Otherwise the user's mean plus
    the deviations of the user's `neighbours` likest other items, weighted by similarity (less
    likeness counts half, an undefined one goes by the ratio of means), held within 1 to 5;
    0.6 user mean + 0.4 item mean if there are no others.  Repeated queries are one.
    """
    ratings = one_rating(ratings)
    dev, users, items = centred(ratings), means(ratings, "user"), means(ratings, "item")
    overall = ratings.agg(F.avg("rating").alias("overall"))
    asked = queries.select("user", "item").distinct().join(users, "user", "left").join(items, "item", "left")
    known = asked.filter("user_mean is not null and item_mean is not null")
    others = known.join(dev.select("user", F.col("item").alias("other"), "deviation"), "user").filter("item <> other")
    others = keep(others.withColumn("a", F.least("item", "other")).withColumn("b", F.greatest("item", "other")))
    likeness = pearson(dev, others.select("a", "b").distinct()).select("a", "b", "similarity")
    # A lasting order of equal weights: by item.
    weighed = others.join(likeness, ["a", "b"], "left").join(items.select(F.col("item").alias("other"), F.col("item_mean").alias("other_mean")), "other")
    s = F.coalesce("similarity", ladder(F.col("item_mean") / F.col("other_mean")))
    weighed = weighed.withColumn("w", F.round(F.when(s < 0, s * 0.5).otherwise(s), 9))
    w = Window.partitionBy("user", "item").orderBy(F.abs("w").desc(), "other")
    top = weighed.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= neighbours)
    summed = top.groupBy("user", "item").agg(F.sum(F.col("w") * F.col("deviation")).alias("num"), F.sum(F.abs("w")).alias("den"))
    joined = asked.join(summed, ["user", "item"], "left").crossJoin(F.broadcast(overall))  # one row
    both = F.col("user_mean").isNotNull() & F.col("item_mean").isNotNull()
    near = F.least(F.greatest(F.col("user_mean") + F.when(F.col("den") > FLAT, F.col("num") / F.col("den")).otherwise(0.0), F.lit(1.0)), F.lit(5.0))
    value = F.when(both & F.col("den").isNotNull(), near).when(both, 0.6 * F.col("user_mean") + 0.4 * F.col("item_mean")).otherwise(F.coalesce("item_mean", "user_mean", "overall"))
    return joined.select("user", "item", value.alias("prediction"))


def features(pairs: DataFrame, users: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """pairs + user_average, user_count, item_average, item_count, days since the user joined, at a stated date.

    An unknown user or item has average 3 and nothing else; if both are unknown all are null.
    """
    u = users.select("user", F.lit(True).alias("has_user"), "user_average", F.coalesce("user_count", F.lit(0)).alias("user_count"), F.datediff(F.lit(as_of).cast("date"), F.to_date("since")).alias("days"))
    i = items.select("item", F.lit(True).alias("has_item"), "item_average", F.coalesce("item_count", F.lit(0)).alias("item_count"))
    j = pairs.join(u, "user", "left").join(i, "item", "left")
    has_u, has_i = F.col("has_user").isNotNull(), F.col("has_item").isNotNull()
    return j.select(*pairs.columns, F.when(has_u, F.col("user_average")).when(has_i, 3.0).alias("user_average"), "user_count", F.when(has_i, F.col("item_average")).when(has_u, 3.0).alias("item_average"), "item_count", "days")


FEATURES = ["user_average", "user_count", "item_average", "item_count", "days"]


def _assembled(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    # Missing values as a value of their own, below all others.
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in FEATURES})
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(filled)


def boosted_trees(train: DataFrame, test: DataFrame, rounds: int = 200, depth: int = 5, rate: float = 0.1, share: str = "0.6", gain: float = 0.0, seed: int = 7) -> DataFrame:
    """Feature rows with a rating, and those to predict -> the latter with prediction."""
    from pyspark.ml.regression import GBTRegressor

    model = GBTRegressor(labelCol="rating", maxIter=rounds, maxDepth=depth, stepSize=rate, featureSubsetStrategy=share, minInfoGain=gain, seed=seed).fit(_assembled(train))
    return model.transform(_assembled(test)).select("user", "item", "prediction")


def tuned_trees(train: DataFrame, grid: dict[str, list], folds: int = 3, seed: int = 7):
    """The best model of a grid (names as GBTRegressor has them) by cross-validated squared error."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    model, build = GBTRegressor(labelCol="rating", seed=seed), ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(model.getParam(name), values)
    return CrossValidator(estimator=model, estimatorParamMaps=build.build(), evaluator=RegressionEvaluator(labelCol="rating"), numFolds=folds, seed=seed).fit(_assembled(train))


def hybrid(queries: DataFrame, first: DataFrame, second: DataFrame, default: Column | float, weight: float = 0.06) -> DataFrame:
    """weight * first + (1 - weight) * second; one alone if the other is missing, the default without both.  Repeated queries stay."""
    j = queries.select("user", "item").join(first.select("user", "item", F.col("prediction").alias("p")), ["user", "item"], "left").join(second.select("user", "item", F.col("prediction").alias("q")), ["user", "item"], "left")
    other = default if isinstance(default, Column) else F.lit(default)
    return j.select("user", "item", F.coalesce(weight * F.col("p") + (1 - weight) * F.col("q"), "p", "q", other).alias("prediction"))

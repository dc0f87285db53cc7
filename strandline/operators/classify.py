"""Evaluation of classifiers: metrics, calibration, thresholds.

Predictions: id, actual, predicted, confidence; probabilities as an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import stored


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def confusion_share(predictions: DataFrame) -> DataFrame:
    """Cells over their true class's rows."""
    total = F.sum("n").over(Window.partitionBy("actual"))
    return confusion(predictions).withColumn("share", F.col("n") / F.greatest(total, F.lit(1)))


def class_report(predictions: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """label, precision, recall, f1, support over all labels seen on either side, or over a fixed list; 0 where undefined."""
    cells = confusion(predictions)
    long = cells.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit(1).alias("is_true")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("is_true")))).alias("x"), "n", (F.col("actual") == F.col("predicted")).alias("hit"))
    sums = long.groupBy("x.label").agg(F.sum(F.when(F.col("hit") & (F.col("x.is_true") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("x.is_true") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("x.is_true") == 0, F.col("n")).otherwise(0)).alias("named"))
    if labels is not None:
        sums = labels.select("label").join(sums, "label", "left").na.fill(0)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    precision, recall = zero(F.try_divide("tp", "named")), zero(F.try_divide("tp", "support"))
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), "support").withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def overall(report: DataFrame, predictions: DataFrame) -> DataFrame:
    weight = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(f"weighted_{c}")
    names = ("precision", "recall", "f1")
    accuracy = predictions.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"))
    return report.agg(*(F.avg(c).alias(f"macro_{c}") for c in names), *(weight(c) for c in names)).crossJoin(accuracy)


def confused_pairs(predictions: DataFrame, k: int = 10, directed: bool = False) -> DataFrame:
    """The k most frequent confusions."""
    wrong = confusion(predictions).filter("actual <> predicted")
    pair = [F.col("actual").alias("a"), F.col("predicted").alias("b")] if directed else [F.least("actual", "predicted").alias("a"), F.greatest("actual", "predicted").alias("b")]
    return wrong.groupBy(*pair).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").limit(k)


def calibration_bins(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """bin (lo, hi], n, accuracy and confidence; empty bins stay, a confidence of 0 is in none."""
    spark = predictions.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    own = predictions.filter("confidence > 0").groupBy((F.ceil(F.col("confidence") * bins).cast("int") - 1).alias("bin")).agg(F.count("*").alias("n"), F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"), F.avg("confidence").alias("confidence"))
    return grid.join(own, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "confidence")


def calibration_error(bins: DataFrame, total: DataFrame) -> DataFrame:
    """Mean distance of accuracy and confidence, over all rows."""
    return bins.crossJoin(total).agg(F.coalesce(F.sum(F.col("n") / F.col("total") * F.abs(F.col("accuracy") - F.col("confidence"))), F.lit(0.0)).alias("ece"))


def threshold_curve(predictions: DataFrame, out_of_domain: DataFrame, steps: int = 100) -> DataFrame:
    """For each threshold: coverage, accuracy of what is accepted (1 if nothing), out-of-domain rows accepted, and balanced accuracy.

    The last is that of accepting a row: right rows should be, wrong and
    out-of-domain rows should not. Rows are counted by the last threshold that
    accepts them, and a running sum over the grid does the rest; no row meets
    every threshold.
    """
    place = F.floor(F.col("confidence") * steps + 1e-9).cast("int")
    inside = predictions.select(place.alias("k"), F.lit(1).alias("i"), (F.col("actual") == F.col("predicted")).cast("int").alias("c"), F.lit(0).alias("o"))
    outside = out_of_domain.select(place.alias("k"), F.lit(0).alias("i"), F.lit(0).alias("c"), F.lit(1).alias("o"))
    return curves(inside.unionByName(outside).groupBy("k").agg(*(F.sum(x).alias(x) for x in "ico")), steps)


def at_or_above(counts: DataFrame, place: str, columns: list[str], steps: int, *by: str) -> DataFrame:
    """A row for each place from 0 to ``steps``, and class: sums of the columns over the places from it on, and over all (all_...)."""
    own = counts.groupBy(*by).agg(*(F.collect_list(F.struct(place, *columns)).alias("_x") for _ in "x"), *(F.sum(c).alias(f"all_{c}") for c in columns))
    upwards = lambda c: F.aggregate(F.filter("_x", lambda x: x[place] >= F.col("_k")), F.lit(0).cast("long"), lambda a, x: a + x[c])
    rows = own.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    return rows.select(*by, F.col("_k").alias(place), *(upwards(c).alias(c) for c in columns), *(F.coalesce(f"all_{c}", F.lit(0)).alias(f"all_{c}") for c in columns))


def curves(counts: DataFrame, steps: int, *by: str) -> DataFrame:
    """``threshold_curve`` by class from counts (k, i: rows, c: right ones, o: out-of-domain ones), at most ``steps`` + 1 a class."""
    rows = at_or_above(counts, "k", ["i", "c", "o"], steps, *by)
    zero = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    accuracy = F.coalesce(F.try_divide("c", "i"), F.lit(1.0))
    negatives = F.col("all_i") - F.col("all_c") + F.col("all_o")
    refused = negatives - (F.col("i") - F.col("c")) - F.col("o")
    balanced = (zero(F.col("c"), F.col("all_c")) + zero(refused, negatives)) / 2
    return rows.select(*by, (F.col("k") / steps).alias("threshold"), zero(F.col("i"), F.col("all_i")).alias("coverage"), accuracy.alias("selective_accuracy"), zero(F.col("o"), F.col("all_o")).alias("ood_accept"), balanced.alias("balanced"))


def pick_threshold(curve: DataFrame, least_coverage: float = 0.9) -> DataFrame:
    """Best balance with enough coverage (any if none has), then coverage, then the lowest threshold."""
    return curve.orderBy((F.col("coverage") >= least_coverage).desc(), F.round("balanced", 6).desc(), F.desc("coverage"), "threshold").limit(1)


def emergency_threshold(rates: DataFrame, default: float = 0.5, most: float = 0.02) -> DataFrame:
    """Lowest threshold over 0, up to the default, whose false rate is low enough, else the default. rates: threshold, false_rate."""
    ok = (F.col("threshold") > 0) & (F.col("threshold") <= default) & (F.col("false_rate") <= most)
    return rates.agg(F.coalesce(F.min(F.when(ok, F.col("threshold"))), F.lit(default)).alias("threshold"))


def temperature_losses(rows: DataFrame, logits: str, label: str, grid: list[float]) -> DataFrame:
    """Mean negative log-likelihood (probabilities from 1e-12) at each temperature; all in one pass."""
    top = F.array_max(logits)

    def loss(t: float) -> Column:
        weight = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp((x - top) / t))
        p = F.exp((F.element_at(logits, F.col(label) + 1) - top) / t) / weight
        return F.avg(-F.ln(F.greatest(p, F.lit(1e-12))))

    wide = rows.agg(*(loss(t).alias(f"t{k}") for k, t in enumerate(grid)))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(t).alias("temperature"), F.col(f"t{k}").alias("nll")) for k, t in enumerate(grid)))))


def fitted_temperature(rows: DataFrame, logits: str, label: str, low: float = 0.05, high: float = 20.0, rounds: int = 4, width: int = 12) -> float:
    """The temperature of least loss: a grid in the logarithm, narrowed around its best, a pass for each round."""
    import math

    a, b = math.log(low), math.log(high)
    for _ in range(rounds):
        grid = [math.exp(a + (b - a) * k / (width - 1)) for k in range(width)]
        best = temperature_losses(rows, logits, label, grid).orderBy("nll", "temperature").head()["temperature"]
        step = (b - a) / (width - 1)
        a, b = max(math.log(low), math.log(best) - step), min(math.log(high), math.log(best) + step)
    return best


def choose_model(models: DataFrame, near: float = 0.005) -> DataFrame:
    """Of models within ``near`` of the best f1 the one with the least latency. models: model, f1, latency."""
    best = F.max("f1").over(Window.partitionBy())
    return models.withColumn("best", best).filter(F.col("f1") >= F.col("best") - near).orderBy("latency", "model").limit(1).drop("best")


def errors(predictions: DataFrame) -> DataFrame:
    return predictions.filter("actual <> predicted").orderBy(F.desc("confidence"), "id")


def fit_text_classifier(rows: DataFrame, text: str, label: str, strength: float = 1.0):
    """Word 1- and 2-grams, smooth idf, multinomial logistic regression, as a Spark ML pipeline.

    The texts are cut twice, for the vocabulary and for the counts of its
    terms, which are stored; idf and regression are fitted on those.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, IDF, NGram, RegexTokenizer, SQLTransformer, StringIndexer

    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep").fit(rows)
    cut = [
        RegexTokenizer(inputCol=text, outputCol="_one", pattern=r"[^\p{L}\p{N}]+"),
        NGram(n=2, inputCol="_one", outputCol="_two"),
        SQLTransformer(statement="SELECT *, concat(_one, _two) AS _terms FROM __THIS__"),
    ]
    terms = PipelineModel([index, *cut]).transform(rows.select(text, label)).select("_label", "_terms")
    count = CountVectorizer(inputCol="_terms", outputCol="_counts").fit(terms)
    counts = stored(count.transform(terms).select("_label", "_counts"))
    idf = IDF(inputCol="_counts", outputCol="features").fit(counts)
    regression = LogisticRegression(labelCol="_label", featuresCol="features", regParam=strength / max(1, counts.count()), maxIter=50)
    return PipelineModel([index, *cut, count, idf, regression.fit(idf.transform(counts))])

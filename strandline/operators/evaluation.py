"""Whole evaluations of a classifier: rates behind a threshold, routing, latency, model choice.

Predictions: id, actual, predicted, confidence, and where a class is watched
``p_label``, its probability. Rates over no rows are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import classify as C
from .checkpoints import saved


def share(condition: Column, among: Column | None = None) -> Column:
    """Of the rows that ``among`` holds for, the share that the condition holds for, too."""
    return F.avg(F.when(F.lit(True) if among is None else among, condition.cast("double")))


def selective_rates(predictions: DataFrame, threshold: float, outside: str) -> DataFrame:
    """One row: how much is accepted, how right that is, errors, and what of the rows marked ``outside`` is accepted."""
    inside, accepted, wrong = ~F.col(outside), F.col("confidence") >= threshold, F.col("actual") != F.col("predicted")
    return predictions.agg(
        F.lit(threshold).alias("threshold"),
        share(accepted, inside).alias("coverage"),
        share(~wrong, inside & accepted).alias("selective_accuracy"),
        F.count_if(inside & accepted & wrong).alias("confident_errors"),
        F.count_if(inside & wrong).alias("errors"),
        F.count_if(~inside).alias("outside"),
        share(accepted, ~inside).alias("false_accept_rate"),
    )


def watched_rates(predictions: DataFrame, label: Column, threshold: float, outside: str) -> DataFrame:
    """One row for a class that must not be missed: recall by its probability and by the best label, and false alarms."""
    inside, watched, alarm = ~F.col(outside), F.col("actual") == label, F.col("p_label") >= threshold
    return predictions.agg(
        F.lit(threshold).alias("threshold"),
        share(alarm, inside & watched).alias("recall"),
        share(alarm, inside & ~watched).alias("false_rate_inside"),
        share(alarm, ~inside).alias("false_rate_outside"),
        share(F.col("predicted") == label, inside & watched).alias("recall_of_best_label"),
    )


def flag_recall(rows: DataFrame, target: Column, flagged: Column) -> DataFrame:
    """One row: recall on the target rows, as a rate and as counts, and others that are flagged."""
    return rows.agg(share(flagged, target).alias("recall"), F.count_if(flagged & target).alias("caught"), F.count_if(target).alias("targets"), F.count_if(flagged & ~target).alias("false_flags"), F.count_if(~target).alias("others"))


def missed(rows: DataFrame, target: Column, flagged: Column) -> DataFrame:
    return rows.filter(target & ~flagged)


def latency(times: DataFrame, column: str, *by: str) -> DataFrame:
    """Mean and 95th percentile, interpolated, of times."""
    return times.groupBy(*by).agg(F.avg(column).alias("mean"), F.percentile(column, 0.95).alias("p95"))


def mean_confidence(predictions: DataFrame) -> DataFrame:
    """Over all rows and over the errors (0 if there are none)."""
    wrong = F.col("actual") != F.col("predicted")
    return predictions.agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.coalesce(F.avg(F.when(wrong, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence_errors"))


def lowest_recall(report: DataFrame, k: int = 5) -> DataFrame:
    return report.select("label", "recall").orderBy("recall", "label").limit(k)


def crossed_counts(rows: DataFrame, by: str, across: str, values: list) -> DataFrame:
    """A row for each ``by``, a column with the count of each value of ``across``; 0 where there is none."""
    return rows.groupBy(by).pivot(across, values).count().na.fill(0)


def best_strength(grid: DataFrame) -> DataFrame:
    """Of a grid (strength, f1) the best f1; ties to the smaller strength."""
    return grid.orderBy(F.desc("f1"), "strength").limit(1)


def grid_search(train: DataFrame, validation: DataFrame, text: str, label: str, strengths: list[float]) -> DataFrame:
    """strength and macro f1 on the validation rows of a classifier fitted for each strength; a bounded list of models."""
    spark, rows = train.sparkSession, []
    for strength in strengths:
        model = C.fit_text_classifier(train, text, label, strength)
        names = model.stages[0].labels
        found = model.transform(validation).select(F.col(label).alias("actual"), F.element_at(F.array(*map(F.lit, [*names, ""])), F.col("prediction").cast("int") + 1).alias("predicted"))
        seen = found.select(F.col("actual").alias("label")).distinct()
        rows.append((strength, C.class_report(found, seen).agg(F.avg("f1")).head()[0]))
    return spark.createDataFrame(rows, "strength double, f1 double")


def evaluation_cells(predictions: DataFrame, *by: str, steps: int = 100, bins: int = 10) -> DataFrame:
    """Counts from which all rates of an evaluation come, in one pass.

    ``predictions``: outside, actual, predicted, confidence, p_label (the
    watched class's probability) and, for calibration before and after,
    raw_confidence. A cell has the last thresholds (``k``, ``w``) that its
    confidence and probability reach, its bins (lo, hi] (null for a
    confidence of 0), the labels, n and the confidences' sums.
    """
    rows = predictions if "raw_confidence" in predictions.columns else predictions.withColumn("raw_confidence", F.col("confidence"))
    place = lambda c: F.floor(F.col(c) * steps + 1e-9).cast("int")
    bin_ = lambda c: F.when(F.col(c) > 0, F.ceil(F.col(c) * bins).cast("int") - 1)
    keys = [place("confidence").alias("k"), place("p_label").alias("w"), bin_("confidence").alias("bin"), bin_("raw_confidence").alias("raw_bin")]
    return rows.groupBy(*by, "outside", "actual", "predicted", *keys).agg(F.count("*").alias("n"), F.sum("confidence").alias("s"), F.sum("raw_confidence").alias("raw_s"))


def _counted(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _right() -> Column:
    return F.col("actual") == F.col("predicted")


def picked_thresholds(cells: DataFrame, *by: str, steps: int = 100, least_coverage: float = 0.9) -> DataFrame:
    """by, threshold: ``classify.pick_threshold`` of each class of cells."""
    inside = ~F.col("outside")
    counts = cells.groupBy(*by, "k").agg(_counted(inside).alias("i"), _counted(inside & _right()).alias("c"), _counted(~inside).alias("o"))
    best = F.max(F.struct((F.col("coverage") >= least_coverage).alias("enough"), F.round("balanced", 6).alias("balanced"), "coverage", (-F.col("threshold")).alias("less")))
    return C.curves(counts, steps, *by).groupBy(*by).agg(best.alias("x")).select(*by, (-F.col("x.less")).alias("threshold"))


def watched_thresholds(cells: DataFrame, label: Column, default: DataFrame, *by: str, steps: int = 100, most: float = 0.02) -> DataFrame:
    """by, emergency_threshold, false_rate, recall of the watched class.

    The lowest threshold over 0, up to the general one (``default``: by,
    threshold), whose alarms among all other rows, outside ones too, are few
    enough; the general one if there is none.
    """
    positive = F.coalesce(F.col("actual") == label, F.lit(False)) & ~F.col("outside")
    counts = cells.groupBy(*by, "w").agg(_counted(positive).alias("p"), _counted(~positive).alias("f"))
    rate = lambda x: F.coalesce(F.try_divide(x, f"all_{x}"), F.lit(0.0))
    rows = C.at_or_above(counts, "w", ["p", "f"], steps, *by).select(*by, (F.col("w") / steps).alias("at"), rate("f").alias("false_rate"), rate("p").alias("recall"))
    joined = rows.join(default, list(by)) if by else rows.crossJoin(default)
    own = F.struct("at", "false_rate", "recall")
    ok = (F.col("at") > 0) & (F.col("at") <= F.col("threshold")) & (F.col("false_rate") <= most)
    found = joined.groupBy(*by).agg(F.coalesce(F.min(F.when(ok, own)), F.min(F.when(F.col("at") == F.col("threshold"), own))).alias("x"))
    return found.select(*by, F.col("x.at").alias("emergency_threshold"), "x.false_rate", "x.recall")


def calibration_errors(cells: DataFrame, *by: str) -> DataFrame:
    """by, ece_before, ece_after: mean distance of accuracy and confidence over bins, of the raw and the calibrated confidences."""
    inside = cells.filter(~F.col("outside"))

    def error(bin_: str, total: str, name: str) -> DataFrame:
        bins = inside.groupBy(*by, bin_).agg(F.sum("n").alias("n"), _counted(_right()).alias("c"), F.sum(total).alias("s"))
        apart = F.coalesce(F.sum(F.when(F.col(bin_).isNotNull(), F.abs(F.col("c") - F.col("s")))), F.lit(0.0))
        return bins.groupBy(*by).agg((apart / F.sum("n")).alias(name))

    before, after = error("raw_bin", "raw_s", "ece_before"), error("bin", "s", "ece_after")
    return before.join(after, list(by)) if by else before.crossJoin(after)


def reports(cells: DataFrame, *by: str) -> DataFrame:
    """by, label, precision, recall, f1, support over the labels seen on either side of in-domain rows; 0 where undefined."""
    counts = cells.filter(~F.col("outside")).groupBy(*by, "actual", "predicted").agg(F.sum("n").alias("n"))
    sides = F.array(F.struct(F.col("actual").alias("label"), F.lit(True).alias("own")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("own")))
    long = counts.select(*by, F.inline(sides), _right().alias("right"), "n")
    sums = long.groupBy(*by, "label").agg(_counted(F.col("own") & F.col("right")).alias("tp"), _counted(F.col("own")).alias("support"), _counted(~F.col("own")).alias("named"))
    zero = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    rated = sums.select(*by, "label", zero(F.col("tp"), F.col("named")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), "support")
    return rated.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def averages(report: DataFrame, *by: str) -> DataFrame:
    """by, macro and weighted averages of a report, and accuracy."""
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    macro = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    # the recalls weighted by support are the share of right rows
    return report.groupBy(*by).agg(*macro, weighted("f1").alias("weighted_f1"), weighted("recall").alias("accuracy"))


def model_evaluation(validation: DataFrame, test: DataFrame, times: DataFrame, label: Column, steps: int = 100, least_coverage: float = 0.9, most: float = 0.02, near: float = 0.005) -> DataFrame:
    """model, metric, value of candidate models, a model's thresholds and the choice of one made on validation rows alone.

    Rows: model and what ``evaluation_cells`` reads. ``times``: model,
    latency. ``selected`` is 1 for the model of the least latency among those
    within ``near`` of the best macro f1. Both tables are read once.
    """
    seen, tested = (saved(evaluation_cells(x, "model", steps=steps)) for x in (validation, test))
    scores = averages(reports(seen, "model"), "model").select("model", F.col("macro_f1").alias("validation_macro_f1")).join(times, "model", "left")
    chosen = C.choose_model(scores.select("model", F.col("validation_macro_f1").alias("f1"), "latency"), near).select(F.col("model").alias("best"))
    general = picked_thresholds(seen, "model", steps=steps, least_coverage=least_coverage)
    limits = general.join(watched_thresholds(seen, label, general, "model", steps=steps, most=most).select("model", "emergency_threshold"), "model")
    inside, watched = ~F.col("outside"), F.col("actual") == label
    # thresholds are on the grid that cells are counted by
    accepted = F.col("k") >= F.round(F.col("threshold") * steps)
    alarm = F.col("w") >= F.round(F.col("emergency_threshold") * steps)
    rate = lambda x, among: F.try_divide(_counted(x & among), _counted(among))
    rates = tested.join(limits, "model").groupBy("model", "threshold", "emergency_threshold").agg(
        rate(accepted, inside).alias("coverage"),
        rate(_right(), inside & accepted).alias("selective_accuracy"),
        _counted(inside & accepted & ~_right()).alias("confident_errors"),
        _counted(inside & ~_right()).alias("errors"),
        rate(accepted, ~inside).alias("false_accept_rate"),
        rate(alarm, inside & watched).alias("watched_recall"),
        rate(alarm, inside & ~watched).alias("false_alarm_rate"),
        rate(alarm, ~inside).alias("false_alarm_rate_outside"),
        rate(F.col("predicted") == label, inside & watched).alias("recall_of_best_label"),
    )
    wide = scores.join(rates, "model").join(averages(reports(tested, "model"), "model"), "model").join(calibration_errors(tested, "model"), "model")
    wide = wide.join(chosen, F.col("model") == F.col("best"), "left").withColumn("selected", F.col("best").isNotNull().cast("int")).drop("best")
    metrics = [c for c in wide.columns if c != "model"]
    return wide.select("model", F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics))))


def calibrated(rows: DataFrame, logits: str, labels: list, watched, temperature: float) -> DataFrame:
    """``rows`` with predicted, raw_confidence, confidence and p_label (of the watched label) from an array of logits at a temperature."""
    from ..functions.vectors import softmax

    cooled = softmax(F.transform(logits, lambda x: x / F.lit(temperature)))
    best = F.array_position(F.col(logits), F.array_max(logits)).cast("int")
    return rows.select("*", F.element_at(F.array(*map(F.lit, labels)), best).alias("predicted"), F.array_max(softmax(F.col(logits))).alias("raw_confidence"), F.array_max(cooled).alias("confidence"), F.element_at(cooled, labels.index(watched) + 1).alias("p_label"))


def calibration(rows: DataFrame, logits: str, label: str, labels: list, watched, outside: str, steps: int = 100, least_coverage: float = 0.9, most: float = 0.02) -> DataFrame:
    """One row: temperature, threshold, emergency_threshold with its false_rate and recall, ece_before and ece_after of a model's logits.

    The temperature is fitted on the rows that aren't ``outside``; thresholds
    are those of the calibrated probabilities.
    """
    inside = rows.filter(~F.col(outside)).withColumn("_place", (F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1).cast("int"))
    temperature = C.fitted_temperature(inside, logits, "_place")
    own = calibrated(rows, logits, labels, watched, temperature).withColumn("actual", F.col(label)).withColumn("outside", F.col(outside))
    cells = saved(evaluation_cells(own, steps=steps))
    general = picked_thresholds(cells, steps=steps, least_coverage=least_coverage)
    found = general.crossJoin(watched_thresholds(cells, F.lit(watched), general, steps=steps, most=most)).crossJoin(calibration_errors(cells))
    return found.select(F.lit(temperature).alias("temperature"), "*")


def calibration_bundle(predictions: DataFrame, outside: str, steps: int = 100, least_coverage: float = 0.9, label: Column | None = None) -> dict[str, DataFrame]:
    """Curve, picked threshold, error of calibration, and the emergency threshold of predictions with in-domain rows and others.

    The emergency threshold is that of ``p_label``, the probability of the
    watched class ``label``; without a class, all rows count as negatives.
    """
    inside, others = predictions.filter(~F.col(outside)), predictions.filter(F.col(outside))
    curve = C.threshold_curve(inside, others, steps)
    general = C.pick_threshold(curve, least_coverage).select("threshold")
    cells = evaluation_cells(predictions.withColumn("outside", F.col(outside)), steps=steps)
    watched = watched_thresholds(cells, F.lit(None) if label is None else label, general, steps=steps)
    return {
        "curve": curve,
        "threshold": general,
        "emergency_threshold": watched.select(F.col("emergency_threshold").alias("threshold")),
        "ece": C.calibration_error(C.calibration_bins(inside), inside.agg(F.count("*").alias("total"))),
    }


def full_evaluation(validation: DataFrame, test: DataFrame, outside: str) -> DataFrame:
    """metric, value: the threshold is picked on the validation rows, and only then are the test rows looked at."""
    threshold = calibration_bundle(validation, outside)["threshold"].head()[0]
    inside = test.filter(~F.col(outside))
    report = C.class_report(inside)
    parts = [selective_rates(test, threshold, outside), C.overall(report, inside), mean_confidence(inside), C.calibration_error(C.calibration_bins(inside), inside.agg(F.count("*").alias("total")))]
    long = [x.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in x.columns)))) for x in parts]
    lowest = lowest_recall(report, 5).select(F.concat(F.lit("recall_of_"), "label").alias("metric"), F.col("recall").alias("value"))
    out = lowest
    for x in long:
        out = out.unionByName(x)
    return out


def predicted_by(rows: DataFrame, model: Callable, schema: str) -> DataFrame:
    """Rows with what a model says of them. ``model``: a function from an iterator of pandas frames to one, run in each task."""
    return rows.mapInPandas(model, schema)


def graded_run(prompts: DataFrame, answer: Callable, name: str) -> DataFrame:
    """Prompts (prompt, gold, kind, ...) with a model's raw output, the extracted answer and whether it is right.

    ``answer``: a function from a pandas series of prompts to one of texts.
    """
    from ..functions.grading import extract_answer, grade

    ask = F.pandas_udf(answer, "string")
    raw = prompts.withColumn("model", F.lit(name)).withColumn("raw_output", ask(F.col("prompt")))
    found = raw.withColumn("extracted", extract_answer(F.col("raw_output"), F.col("kind")))
    return found.withColumn("is_correct", grade(F.col("extracted"), F.col("gold"), F.col("kind")))


def gradable(rows: DataFrame, answer: str, order: list[str], most: int | None = None) -> DataFrame:
    """Rows with an answer; the first ``most`` in a stated order, if a number is given."""
    rows = rows.filter(F.col(answer).isNotNull())
    return rows.orderBy(*order).limit(most) if most else rows


def first_tokens(text: Column, most: int) -> Column:
    """The first tokens between white space, joined by blanks."""
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, most), " ")


def pass_rates(outcomes: DataFrame) -> DataFrame:
    """model, task, score of outcomes (model, task, eligible, passed, overlap): the mean overlap where there is one, else the share passed; null without rows."""
    own = F.when(F.col("eligible"), F.coalesce(F.col("overlap"), F.col("passed").cast("double")))
    return outcomes.groupBy("model", "task").agg(F.avg(own).alias("score"), F.count_if("eligible").alias("n"))


def suite(scores: DataFrame, tasks: list[str]) -> DataFrame:
    """A row for each model, a column for each task."""
    return scores.groupBy("model").pivot("task", tasks).agg(F.first("score"))


def restricted(structural: DataFrame, downstream: DataFrame, parameters: DataFrame) -> DataFrame:
    """Structural peaks of the models that have downstream scores, too, with their parameter count where it is known."""
    return structural.join(downstream, "model").join(parameters, "model", "left")


def with_task_scores(latent: DataFrame, scores: DataFrame) -> DataFrame:
    """Latent extremes by model with the models' task scores, null where there are none."""
    return latent.join(scores, "model", "left")


def synthetic_scores(peaks: DataFrame, weights: dict[str, tuple[float, dict[str, float]]], seed: int = 0, spread: float = 0.05) -> DataFrame:
    """Made-up task scores that follow min-max scaled peaks (model, and a column for each metric).

    ``weights``: task -> (base, metric -> weight). Clipped to 0 and 1; the
    noise is a hash of model and task.
    """
    from ..functions.prng import uniform

    every = Window.partitionBy()
    metrics = sorted({m for _, x in weights.values() for m in x})
    scaled = peaks.select("model", *(((F.col(m) - F.min(m).over(every)) / (F.max(m).over(every) - F.min(m).over(every) + 1e-9)).alias(m) for m in metrics))

    def score(task: str) -> Column:
        base, own = weights[task]
        value = F.lit(base) + (uniform(F.lit(seed), F.col("model"), F.lit(task)) - 0.5) * 2 * spread
        for m, w in own.items():
            value = value + F.col(m) * w
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias(task)

    return scaled.select("model", *map(score, weights))


def provenance(models: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: the models, whether any has random weights by its name, and whether any score is synthetic."""
    names = models.agg(F.array_sort(F.collect_set("model")).alias("models"), F.coalesce(F.bool_or(F.col("model").rlike("tiny|random")), F.lit(False)).alias("random_weights"))
    return names.crossJoin(scores.agg(F.coalesce(F.bool_or(F.coalesce("synthetic", F.lit(False))), F.lit(False)).alias("synthetic_scores")))


def corpus_counts(programs: DataFrame) -> DataFrame:
    """One row: programs, those with a pair of each kind, definition-use pairs, and repositories. programs: repo, syntactic, control, n_uses."""
    return programs.agg(F.count("*").alias("programs"), F.count_if("syntactic").alias("syntactic_pairs"), F.count_if("control").alias("control_flow_pairs"), F.coalesce(F.sum("n_uses"), F.lit(0)).alias("definition_uses"), F.count_distinct("repo").alias("repositories"))


def graded_by_rule(records: DataFrame, rule: str, score: str) -> DataFrame:
    """n and mean score by rule and, with a null rule, over all; no records give one row with n 0."""
    return records.rollup(rule).agg(F.count("*").alias("n"), F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"))

"""Scoring detection against gold spans, and the accuracy gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.constants import (
    GATE_LABEL_F1,
    GATE_LABEL_PRECISION,
    GATE_MICRO_F1,
    GATED_LABELS,
    NEGATIVE_FP_BUDGET,
    PERSON_MIN_LENGTH,
)
from wardlake.functions.expressions import empty_array
from wardlake.functions.pii import SPAN_TYPE, detect_spans


def forms_overlap(a: Column, b: Column) -> Column:
    """Whether one form holds the other, ignoring case and outer space; empty never does."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def scored_spans(spans: Column) -> Column:
    """Spans that count: very short person names do not."""
    return F.filter(
        spans, lambda s: ~((s["label"] == "PERSON") & (F.length(s["text"]) < PERSON_MIN_LENGTH))
    )


def greedy_matches(gold: Column, predicted: Column) -> Column:
    """How many predictions find a gold form, each taking the first free one it overlaps."""

    def take(used: Column, form: Column) -> Column:
        numbered = F.transform(
            gold,
            lambda g, i: F.when(~F.array_contains(used, i) & forms_overlap(form, g), i),
        )
        return F.concat(used, F.slice(F.array_compact(numbered), 1, 1))

    return F.size(F.aggregate(predicted, empty_array("int"), take)).cast("bigint")


def predict(records: DataFrame) -> DataFrame:
    """Replace the spans of records by detected ones; every other field stays."""
    return records.withColumn("spans", detect_spans("text"))


def duplicate_ids(records: DataFrame) -> DataFrame:
    """Ids that occur more than once."""
    return records.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def document_counts(gold: DataFrame, predicted: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """`(id, label, tp, fp, fn)` per document and label.

    Gold and predictions are united and meet in one grouping by id; a duplicate id fails
    the job there. Matching happens inside the row, so no group of spans is collected. A
    prediction without gold is all false positives, and the reverse. `extra` names gold
    columns to carry along.
    """
    kind = f"array<{SPAN_TYPE}>"
    sides = gold.select("id", F.lit("gold").alias("_side"), F.col("spans").cast(kind).alias("spans"), *extra).unionByName(
        predicted.select("id", F.lit("prediction").alias("_side"), F.col("spans").cast(kind).alias("spans")), allowMissingColumns=True
    )

    def of(side: str, column: str) -> Column:
        return F.first(F.when(F.col("_side") == side, F.col(column)), ignorenulls=True)

    grouped = sides.groupBy("id").agg(
        *(F.count_if(F.col("_side") == side).alias(f"_n_{side}") for side in ("gold", "prediction")),
        of("gold", "spans").alias("_gold"), of("prediction", "spans").alias("_predicted"), *(of("gold", c).alias(c) for c in extra),
    )

    def spans(side: str, column: str) -> Column:
        duplicate = F.raise_error(F.concat(F.lit(f"duplicate {side} id: "), F.col("id"))).cast(kind)
        return F.when(F.col(f"_n_{side}") > 1, duplicate).otherwise(scored_spans(F.coalesce(F.col(column), empty_array(SPAN_TYPE))))

    joined = grouped.select("id", *extra, spans("gold", "_gold").alias("g"), spans("prediction", "_predicted").alias("p"))
    label_of = lambda s: s["label"]
    labels = F.array_union(F.transform("g", label_of), F.transform("p", label_of))
    per_label = joined.select("id", *extra, "g", "p", F.explode(labels).alias("label"))
    forms = lambda c: F.transform(
        F.filter(c, lambda s: s["label"] == F.col("label")), lambda s: s["text"]
    )
    counted = per_label.select("id", *extra, "label", forms("g").alias("g"), forms("p").alias("p")).withColumn(
        "tp", greedy_matches(F.col("g"), F.col("p"))
    )
    return counted.select(
        "id", *extra, "label", "tp",
        (F.size("p") - F.col("tp")).alias("fp"),
        (F.size("g") - F.col("tp")).alias("fn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    """Add precision, recall and F1; each is 0 when its denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rated = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", _ratio(2 * p * r, p + r))


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn")]


def score(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per-label rows and the micro total (label NULL), best F1 first when ordered."""
    counts = document_counts(gold, predicted)
    return with_rates(counts.rollup("label").agg(*_sums()))


def best_first(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.col("f1").desc(), "label")


def breakdown(gold: DataFrame, predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores per tier, per surface, per label, and in total."""
    counts = document_counts(gold, predicted, extra=("surface",))
    tiers = labels.select(F.col("key").alias("label"), "tier")
    joined = counts.join(tiers, "label", "left")
    grouped = joined.groupingSets(
        [[F.col("tier")], [F.col("surface")], [F.col("label")], []],
        F.col("tier"), F.col("surface"), F.col("label"),
    ).agg(F.grouping_id().alias("level"), *_sums())
    return with_rates(grouped)


def false_positive_rate(counts: DataFrame, records: DataFrame) -> DataFrame:
    """Share of negative documents with a false positive."""
    flagged = counts.where(F.col("fp") > 0).agg(F.count_distinct("id"))
    totals = records.agg(F.count("*").alias("docs")).select("docs", flagged.scalar().alias("flagged"))
    return totals.withColumn("rate", _ratio(F.col("flagged"), F.col("docs")))


def gated_scores(spark: SparkSession, scores: DataFrame) -> DataFrame:
    """The gated labels, 0 where missing, plus their common micro score (`TIER1`)."""
    gated = spark.createDataFrame([(label,) for label in GATED_LABELS], "label string")
    found = gated.join(scores.where(F.col("label").isNotNull()).select("label", "tp", "fp", "fn"), "label", "left")
    rolled = found.rollup("label").agg(*_sums())
    return with_rates(rolled).withColumn("label", F.coalesce("label", F.lit("TIER1")))


def gate_synth(gated: DataFrame) -> DataFrame:
    """`(label, measure, value, floor)` of everything below its floor; empty means pass."""
    is_micro = F.col("label") == "TIER1"
    f1_floor = F.when(is_micro, GATE_MICRO_F1).otherwise(GATE_LABEL_F1)
    measures = F.array(
        F.struct(F.lit("f1").alias("measure"), F.col("f1").alias("value"), f1_floor.alias("floor")),
        F.struct(
            F.lit("precision").alias("measure"), F.col("precision").alias("value"),
            F.when(~is_micro, GATE_LABEL_PRECISION).alias("floor"),
        ),
    )
    return gated.select("label", F.explode(F.filter(measures, lambda m: m["value"] < m["floor"])).alias("m")).select(
        "label", "m.*"
    )


def gate_negative(counts: DataFrame, budget: int = NEGATIVE_FP_BUDGET) -> DataFrame:
    """`(fp, budget, passed)` over hard negatives."""
    return counts.agg(F.coalesce(F.sum("fp"), F.lit(0)).cast("bigint").alias("fp")).select(
        "fp", F.lit(budget).cast("bigint").alias("budget"), (F.col("fp") <= budget).alias("passed")
    )


def markdown_rows(scores: DataFrame) -> DataFrame:
    """One Markdown table row per score."""
    number = lambda c: F.format_string("%.3f", F.col(c))
    cells = [F.coalesce("label", F.lit("micro")), number("f1"), number("precision"), number("recall"), "tp", "fp", "fn"]
    return scores.select(
        "label", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row")
    )

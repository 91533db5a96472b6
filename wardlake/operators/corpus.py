"""Evaluation corpora: generation, normalization, and contract checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.constants import DIFFICULTIES, EVAL_SOURCES, LANGUAGES, SPLITS, SURFACES, TIERS, VERDICTS
from wardlake.functions import synth
from wardlake.functions.expressions import computed, empty_array, utf16_length
from wardlake.functions.pii import SPAN_TYPE
from wardlake.schemas import LABEL_MAP_SCHEMA, LABEL_SCHEMA, META_TYPE, RECORD_COLUMNS


def split_of(i: Column) -> Column:
    """Every fifth record is for development."""
    return F.when(i % 5 == 0, "dev").otherwise("test")


def record_number(n: Column) -> Column:
    """A number with at least five digits; longer ones are kept whole."""
    digits = n.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(5)), F.lit("0"))


def positive_records(cells: DataFrame, seed: int) -> DataFrame:
    """Records with one embedded value each.

    `cells` has `n` (record number), `i` (number within its group), `label`, `surface`
    and `first_draw`; every record is a function of its own row.
    """
    valued = computed(cells, "_draws", synth.draws(seed, F.col("first_draw"), max(synth.DRAWS.values())))
    valued = computed(valued, "_value", synth.value_of(F.col("label"), F.col("_draws")))
    valued = computed(valued, "text", synth.positive_text(F.col("surface"), F.col("label"), F.col("_value")))
    before = F.instr("text", F.col("_value")) - 1
    start = utf16_length(F.substring(F.col("text"), F.lit(1), before))
    span = F.struct(
        start.alias("start"),
        (start + utf16_length(F.col("_value"))).alias("end"),
        F.col("label"),
        F.col("_value").alias("text"),
        F.lit(1).cast("bigint").alias("tier"),
    )
    meta = F.struct(
        split_of(F.col("i")).alias("split"), F.lit(None).cast("string").alias("difficulty"),
        F.lit("api-body").alias("domain"),
    )
    return valued.withColumns(
        {
            "id": F.concat(F.lit("synthetic-"), record_number(F.col("n"))),
            "source": F.lit("synthetic"),
            "lang": F.lit("ko"),
            "spans": F.array(span).cast(f"array<{SPAN_TYPE}>"),
            "meta": meta.cast(META_TYPE),
        }
    ).select(*RECORD_COLUMNS)


def positives(spark: SparkSession, per_cell: int = 35, seed: int = 42) -> DataFrame:
    """The standard positive set: every label on every surface, `per_cell` times."""
    labels, first = [], 0
    for order, (label, used) in enumerate(synth.DRAWS.items()):
        labels.append((order, label, used, first))
        first += used * per_cell * len(SURFACES)
    # Six labels and six surfaces per number; the range carries the size.
    label_cells = [
        F.struct(*[F.lit(v).alias(k) for k, v in zip(("label_no", "label", "used", "base"), row)]) for row in labels
    ]
    surface_cells = [F.struct(F.lit(n).alias("surface_no"), F.lit(s).alias("surface")) for n, s in enumerate(SURFACES)]
    grid = (
        spark.range(per_cell)
        .select(F.col("id").alias("i"), F.explode(F.array(*label_cells)).alias("l"))
        .select("i", "l.*", F.explode(F.array(*surface_cells)).alias("s"))
        .select("*", "s.*")
    )
    within = F.col("surface_no") * per_cell + F.col("i")
    cells = grid.withColumns(
        {
            "n": F.col("label_no") * per_cell * len(SURFACES) + within,
            "first_draw": F.col("base") + within * F.col("used") + 1,
        }
    )
    return positive_records(cells, seed)


def negative_records(cells: DataFrame, seed: int) -> DataFrame:
    """Records that look like personal data and hold none.

    `cells` has `n`, `i` and `kind`; the surface cycles with `i`.
    """
    stream = synth.draws(seed, F.col("n").cast("bigint") * synth.NEGATIVE_DRAWS + 1, synth.NEGATIVE_DRAWS)
    surface = F.get(F.lit(SURFACES), (F.col("i") % len(SURFACES)).cast("int"))
    valued = computed(cells.withColumn("surface", surface), "_draws", stream)
    valued = computed(valued, "_value", synth.negative_of(F.col("kind"), F.col("_draws")))
    meta = F.struct(
        split_of(F.col("i")).alias("split"), F.lit("hard").alias("difficulty"), F.col("kind").alias("domain")
    )
    return valued.withColumns(
        {
            "id": F.concat(F.lit("hard-negative-"), record_number(F.col("n"))),
            "source": F.lit("hard-negative"),
            "lang": F.lit("ko"),
            "text": synth.negative_text(F.col("surface"), F.col("_value")),
            "spans": empty_array(SPAN_TYPE),
            "meta": meta.cast(META_TYPE),
        }
    ).select(*RECORD_COLUMNS)


def negatives(spark: SparkSession, per_kind: int = 250, seed: int = 7) -> DataFrame:
    """The standard hard-negative set."""
    kinds = F.array(*[F.struct(F.lit(n).alias("kind_no"), F.lit(k).alias("kind")) for n, k in enumerate(synth.NEGATIVES)])
    cells = spark.range(per_kind).select(F.col("id").alias("i"), F.explode(kinds).alias("k")).select("i", "k.*")
    return negative_records(cells.withColumn("n", F.col("kind_no") * per_kind + F.col("i")), seed)


def union_sources(*sets: DataFrame) -> DataFrame:
    """One table of several record sets."""
    union = sets[0]
    for s in sets[1:]:
        union = union.unionByName(s)
    return union


# Labels and normalization


def label_tables(spark: SparkSession, labels: Mapping[str, Mapping]) -> tuple[DataFrame, DataFrame]:
    """`labels` and `label_map` tables of a label configuration.

    A source mapping may be absent, one code, or a list of codes.
    """
    rows, codes = [], []
    for key, v in labels.items():
        ref = v.get("ref_f1")
        rows.append(
            (key, v["tier"], v["severity"], v["method"], v["default_action"], None if ref is None else float(ref))
        )
        for source, mapped in (v.get("map") or {}).items():
            listed = [] if mapped is None else [mapped] if isinstance(mapped, str) else list(mapped)
            if not all(isinstance(c, str) for c in listed):
                raise TypeError(f"label map entries must be strings: {key}")
            codes += [(source, c, key) for c in listed]
    return spark.createDataFrame(rows, LABEL_SCHEMA), spark.createDataFrame(codes, LABEL_MAP_SCHEMA)


def map_labels(codes: DataFrame, label_map: DataFrame, source: str) -> DataFrame:
    """Add the canonical `key` of each source `code`, NULL when unmapped.

    The label configuration has a few dozen rows; it is broadcast if that holds.
    """
    known = label_map.where(F.col("source") == source).select("code", "key")
    return codes.join(known, "code", "left")


def normalize_kdpii(raw: DataFrame, labels: DataFrame, label_map: DataFrame, split: str) -> DataFrame:
    """Corpus sentences as evaluation records, with `dropped` unmapped spans per record.

    Label codes are looked up in a one-row map built from the configuration, so the
    spans of a sentence never leave its row.
    """
    if split not in ("test", "valid"):
        raise ValueError(f"unsupported corpus split: {split!r}")
    codes = (
        label_map.where(F.col("source") == "kdpii")
        .join(labels.select("key", "tier"), "key")
        .select("code", F.struct("key", F.col("tier").cast("bigint").alias("tier")).alias("label"))
    )
    # Configuration of a few dozen codes; the map is a scalar of the query.
    known = codes.agg(F.map_from_entries(F.collect_list(F.struct("code", "label"))))
    joined = raw.withColumn("_known", known.scalar())
    source_spans = F.coalesce(F.col("PII_set"), F.array().cast(raw.schema["PII_set"].dataType))
    mapped = F.filter(source_spans, lambda p: F.map_contains_key("_known", p["label"]))
    span = lambda p: F.struct(
        p["begin"].alias("start"),
        p["end"].alias("end"),
        F.try_element_at(F.col("_known"), p["label"])["key"].alias("label"),
        F.substring(F.col("sentence"), (p["begin"] + 1).cast("int"), (p["end"] - p["begin"]).cast("int")).alias("text"),
        F.try_element_at(F.col("_known"), p["label"])["tier"].alias("tier"),
    )
    meta = F.struct(
        F.lit("dev" if split == "valid" else "test").alias("split"),
        F.lit(None).cast("string").alias("difficulty"), F.lit("chat").alias("domain"),
    )
    return joined.select(
        F.concat(F.lit(f"kdpii-{split}-"), record_number(F.col("sent_idx"))).alias("id"),
        F.lit("kdpii").alias("source"),
        F.lit("prose").alias("surface"),
        F.lit("ko").alias("lang"),
        F.col("sentence").alias("text"),
        F.transform(mapped, span).alias("spans"),
        meta.cast(META_TYPE).alias("meta"),
        (F.size(source_spans) - F.size(mapped)).cast("bigint").alias("dropped"),
    )


def inventory(records: DataFrame) -> DataFrame:
    """Documents, spans and dropped spans of a corpus."""
    dropped = F.col("dropped") if "dropped" in records.columns else F.lit(0)
    return records.agg(
        F.count("*").alias("docs"),
        F.coalesce(F.sum(F.size("spans")), F.lit(0)).cast("bigint").alias("spans"),
        F.coalesce(F.sum(dropped), F.lit(0)).cast("bigint").alias("dropped"),
    )


# Contracts


def span_violations(records: DataFrame, labels: DataFrame) -> DataFrame:
    """`(id, start, end, reason)` of spans that break the record contract.

    Texts are compared but never shown.
    """
    length = utf16_length(F.col("text"))
    spans = records.select(
        "id", length.alias("_units"), "text", F.explode("spans").alias("s")
    ).select(
        "id", "s.start", "s.end", "s.label", "s.tier", "_units",
        slice_equals(F.col("text"), F.col("s.start"), F.col("s.end"), F.col("s.text")).alias("_same"),
    )
    known = labels.select(F.col("key").alias("label"), F.col("tier").alias("_tier"))
    reason = (
        F.when(~((F.col("start") >= 0) & (F.col("end") > F.col("start"))), "offsets")
        .when(F.col("end") > F.col("_units"), "past_end")
        .when(~F.col("_same"), "text_differs")
        .when(F.col("_tier").isNull(), "unknown_label")
        .when(F.col("_tier") != F.col("tier"), "tier_disagrees")
    )
    checked = spans.join(known, "label", "left")
    return checked.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("id", "start", "end", "reason")


def slice_equals(text: Column, start: Column, end: Column, expected: Column) -> Column:
    """Whether the text between two UTF-16 offsets is `expected`.

    Compared as encoded bytes, so offsets inside a character simply do not match.
    """
    piece = F.substring(F.encode(text, "UTF-16BE"), (start * 2 + 1).cast("int"), ((end - start) * 2).cast("int"))
    return F.coalesce((start >= 0) & (end >= start) & (piece == F.encode(expected, "UTF-16BE")), F.lit(False))


def record_violations(records: DataFrame) -> DataFrame:
    """`(id, reason)` of records that break the schema's enumerations and required fields."""
    required = [F.when(F.col(c).isNull(), f"missing_{c}") for c in ("source", "surface", "lang", "text", "spans")]
    checks = [
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "empty_id"),
        *required,
        F.when(~F.col("source").isin(EVAL_SOURCES), "source"),
        F.when(~F.col("surface").isin(SURFACES), "surface"),
        F.when(~F.col("lang").isin(LANGUAGES), "lang"),
        F.when(~F.col("meta.split").isin(SPLITS), "split"),
        F.when(~F.col("meta.difficulty").isin(DIFFICULTIES), "difficulty"),
        F.when(
            F.exists(
                "spans",
                lambda s: s["start"].isNull() | s["end"].isNull() | s["label"].isNull() | s["text"].isNull()
                | s["tier"].isNull() | ~s["tier"].isin(TIERS) | ~s["label"].rlike("^[A-Z][A-Z0-9_]*$"),
            ),
            "span",
        ),
    ]
    return records.select("id", F.explode(F.array_compact(F.array(*checks))).alias("reason"))


def policy_violations(rules: DataFrame) -> DataFrame:
    """`(pos, reason)` of rules that break the policy contract."""
    checks = [
        *[F.when(F.col(c).isNull(), f"missing_{c}") for c in ("name", "endpoint", "condition", "verdict")],
        F.when(~F.col("verdict").isin(VERDICTS), "verdict"),
    ]
    return rules.select("pos", F.explode(F.array_compact(F.array(*checks))).alias("reason"))


def egress_violations(egress: DataFrame) -> DataFrame:
    """`(kind, pattern, reason)` of list entries that break the policy contract."""
    checks = [
        F.when(F.coalesce(~F.col("kind").isin("allow", "deny"), F.lit(True)), "kind"),
        F.when(F.col("pattern").isNull(), "missing_pattern"),
    ]
    return egress.select("kind", "pattern", F.explode(F.array_compact(F.array(*checks))).alias("reason"))


def policy_document_problems(doc: Mapping) -> list[str]:
    """Problems of a policy document itself: keys and version."""
    problems = [f"unknown key: {k}" for k in doc if k not in ("version", "egress", "rules")]
    version = doc.get("version")
    if version is not None and (not isinstance(version, int) or isinstance(version, bool) or version < 1):
        problems.append("version must be a positive integer")
    egress = doc.get("egress") or {}
    problems += [f"unknown egress key: {k}" for k in egress if k not in ("default", "allow", "deny")]
    if egress.get("default", "deny") not in VERDICTS:
        problems.append("unknown default verdict")
    allowed: Sequence[str] = ("name", "endpoint", "condition", "verdict")
    for pos, rule in enumerate(doc.get("rules") or ()):
        problems += [f"rule {pos}: missing {k}" for k in allowed if k not in rule]
        problems += [f"rule {pos}: unknown key {k}" for k in rule if k not in allowed]
        if rule.get("verdict") not in VERDICTS:
            problems.append(f"rule {pos}: unknown verdict")
    return problems

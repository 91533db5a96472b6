"""Policy documents in a table: what is wrong with them, and the rules and lists they hold.

`documents` has (policy, doc), doc a JSON text. Texts are parsed as VARIANT, whose keys and
entries become rows, so unknown keys are seen and documents of any shape cost one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.constants import VERDICTS

# The keys of a policy document and of its parts.
DOCUMENT_KEYS = ["version", "egress", "rules"]
EGRESS_KEYS = ["default", "allow", "deny"]
RULE_KEYS = ["name", "endpoint", "condition", "verdict"]
_END = "end of document"


def _parsed(documents: DataFrame) -> DataFrame:
    """The parsed texts. The parser stops at the end of a value, so a mark shows that nothing follows it."""
    marked = F.try_parse_json(F.concat(F.lit('{"doc":'), "doc", F.lit(f',"{_END}":0}}')))
    whole = F.try_variant_get(marked, f"$['{_END}']", "int") == 0
    return documents.select("policy", marked.alias("m"), whole.alias("whole")).select(
        "policy", F.when(F.col("whole"), F.try_variant_get("m", "$.doc", "variant")).alias("v")
    )


def _kind(value: Column) -> Column:
    """`OBJECT`, `ARRAY`, `STRING`, `BIGINT` and the like; NULL for SQL NULL."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _at(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _entries(rows: DataFrame, value: Column, *carried: str) -> DataFrame:
    """A row per key of an object, or entry of an array: carried columns, key, pos, value."""
    spark = rows.sparkSession
    exploded = spark.tvf.variant_explode(value.outer())
    return rows.lateralJoin(exploded).select(*carried, "key", "pos", "value")


def _rules(documents: DataFrame) -> DataFrame:
    """(policy, pos, rule) of documents that are objects."""
    objects = _parsed(documents).where(_kind(F.col("v")) == "OBJECT").withColumn("rules", _at(F.col("v"), "$.rules", "variant"))
    listed = objects.where(_kind(F.col("rules")) == "ARRAY")
    return _entries(listed, F.col("rules"), "policy").select("policy", "pos", F.col("value").alias("rule"))


def document_problems(documents: DataFrame) -> DataFrame:
    """(policy, problem): everything in which a document breaks the contract."""
    parsed = _parsed(documents)
    whole = parsed.where(F.coalesce(_kind(F.col("v")), F.lit("")) == "OBJECT")
    broken = parsed.where(F.coalesce(_kind(F.col("v")), F.lit("")) != "OBJECT").select("policy", F.lit("not a document").alias("problem"))
    version, egress = _at(F.col("v"), "$.version", "variant"), _at(F.col("v"), "$.egress", "variant")
    is_set = version.isNotNull() & ~F.is_variant_null(version)
    number = F.when(_kind(version) == "BIGINT", F.try_variant_get(version, "$", "bigint"))
    default = _at(F.col("v"), "$.egress.default", "variant")
    text = F.when(_kind(default) == "STRING", F.try_variant_get(default, "$", "string"))
    checks = F.array(
        F.when(is_set & ~F.coalesce(number >= 1, F.lit(False)), "version must be a positive integer"),
        F.when(default.isNotNull() & ~F.coalesce(text.isin(VERDICTS), F.lit(False)), "unknown default verdict"),
    )
    general = whole.select("policy", F.explode(F.array_compact(checks)).alias("problem"))
    keys = _entries(whole, F.col("v"), "policy").where(~F.col("key").isin(DOCUMENT_KEYS))
    lists = whole.withColumn("egress", egress).where(_kind(F.col("egress")) == "OBJECT")
    egress_keys = _entries(lists, F.col("egress"), "policy").where(~F.col("key").isin(EGRESS_KEYS))
    rules = _rules(documents)
    prefix = F.concat(F.lit("rule "), F.col("pos").cast("string"), F.lit(": "))
    verdict = F.when(_kind(_at(F.col("rule"), "$.verdict", "variant")) == "STRING", _at(F.col("rule"), "$.verdict", "string"))
    faults = F.array(
        *(F.when(_at(F.col("rule"), f"$.{key}", "variant").isNull(), f"missing {key}") for key in RULE_KEYS),
        F.when(~F.coalesce(verdict.isin(VERDICTS), F.lit(False)), "unknown verdict"),
    )
    of_rules = rules.select("policy", F.explode(F.transform(F.array_compact(faults), lambda x: F.concat(prefix, x))).alias("problem"))
    objects = rules.where(_kind(F.col("rule")) == "OBJECT").withColumnRenamed("pos", "at")
    rule_keys = _entries(objects, F.col("rule"), "policy", "at").where(~F.col("key").isin(RULE_KEYS))
    parts = [
        broken, general, of_rules,
        keys.select("policy", F.concat(F.lit("unknown key: "), "key").alias("problem")),
        egress_keys.select("policy", F.concat(F.lit("unknown egress key: "), "key").alias("problem")),
        rule_keys.select("policy", F.concat(F.lit("rule "), F.col("at").cast("string"), F.lit(": unknown key "), "key").alias("problem")),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def document_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rules, domain lists and defaults of documents, as `rule_tables.decide_by_tables` takes them.

    Documents with problems are left to the caller; what has the wrong type becomes NULL.
    """
    rules = _rules(documents).select("policy", "pos", *(_at(F.col("rule"), f"$.{key}", "string").alias(key) for key in RULE_KEYS))
    parsed = _parsed(documents)
    lists = None
    for kind in ("allow", "deny"):
        patterns = parsed.select("policy", F.explode(_at(F.col("v"), f"$.egress.{kind}", "array<string>")).alias("pattern"))
        patterns = patterns.select("policy", F.lit(kind).alias("kind"), "pattern")
        lists = patterns if lists is None else lists.unionByName(patterns)
    defaults = parsed.select("policy", F.coalesce(_at(F.col("v"), "$.egress.default", "string"), F.lit("deny")).alias("default"))
    return rules.select("policy", "pos", "name", "endpoint", "condition", "verdict"), lists, defaults

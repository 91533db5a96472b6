"""The placeholder → secret table: building, merging, retention, restoring.

These tables hold live secrets: keep them on a restricted path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.expressions import computed, empty_array
from wardlake.functions.masking import placeholders_in, restore_text
from wardlake.operators.sizing import top_per_group


def mapping_rows(redactions: DataFrame, mapping: str, seq: str, salt_id: str) -> DataFrame:
    """Explode a mapping column into `(salt_id, placeholder, secret, last_seq)`."""
    return redactions.select(
        F.col(salt_id).alias("salt_id"),
        F.explode(F.map_entries(F.coalesce(F.col(mapping), F.create_map().cast("map<string,string>")))).alias("e"),
        F.col(seq).cast("bigint").alias("last_seq"),
    ).select("salt_id", F.col("e.key").alias("placeholder"), F.col("e.value").alias("secret"), "last_seq")


def merge(*mappings: DataFrame) -> DataFrame:
    """Union of mapping tables; the latest value of a placeholder wins.

    Two transports that share a salt share their placeholders. The aggregation
    combines on the map side, so a placeholder in every document stays cheap.
    """
    union = mappings[0]
    for m in mappings[1:]:
        union = union.unionByName(m)
    return union.groupBy("salt_id", "placeholder").agg(
        F.max_by("secret", "last_seq").alias("secret"), F.max("last_seq").alias("last_seq")
    )


def retained(
    mapping: DataFrame,
    max_entries: int | None = None,
    max_bytes: int | None = None,
    store: Sequence[str] = ("salt_id",),
) -> DataFrame:
    """What a bounded store keeps: the newest entries while both caps hold; all without caps.

    Recording an entry again only moves it to the newest end and eviction only takes
    the oldest, so the kept set is the longest newest-first run within both caps. The
    entry cap is a rank limit and prunes before the shuffle; the byte cap is a running
    sum over what is left, at most `max_entries` rows per store.
    """
    if any(cap is not None and cap <= 0 for cap in (max_entries, max_bytes)):
        raise ValueError("a mapping store must be able to hold something")
    order = [F.col("last_seq").desc(), F.col("placeholder")]
    ranked = merge(mapping)
    if max_entries is not None:
        ranked = top_per_group(ranked, store, order, max_entries, ["placeholder"], "_rank").drop("_rank")
    if max_bytes is None:
        return ranked
    newest = Window.partitionBy(*store).orderBy(*order)
    total = F.sum(F.octet_length("secret")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    # Bytes only grow along the run, so the kept rows are a prefix.
    return ranked.withColumn("_bytes", total).where(F.col("_bytes") <= max_bytes).drop("_bytes")


def retention_stats(kept: DataFrame, store: Sequence[str] = ("salt_id",)) -> DataFrame:
    """Entries and secret bytes per store."""
    return kept.groupBy(*store).agg(
        F.count("*").alias("entries"),
        F.sum(F.octet_length("secret")).cast("bigint").alias("bytes"),
    )


def restore(texts: DataFrame, mapping: DataFrame, id_column: str, text: str, salt_id: str) -> DataFrame:
    """Replace the placeholders that the mapping table knows, in any number of texts.

    `id_column` must be unique; of several secrets of a placeholder the latest is used.
    Placeholders are extracted and looked up by an equi join, so neither side must fit
    in memory. Only texts with placeholders are shuffled; the rest passes through.
    """
    scanned = computed(texts, "_tokens", F.array_distinct(F.coalesce(placeholders_in(text), empty_array("string"))))
    plain = scanned.where(F.size("_tokens") == 0).drop("_tokens")
    found = scanned.where(F.size("_tokens") > 0)
    tokens = found.select(id_column, F.col(salt_id).alias("salt_id"), F.explode(F.col("_tokens")).alias("placeholder"))
    known = (
        tokens.join(mapping.select("salt_id", "placeholder", "secret", "last_seq"), ["salt_id", "placeholder"])
        .groupBy(id_column, "placeholder").agg(F.max_by("secret", "last_seq").alias("secret"))
        .groupBy(id_column)
        .agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "secret"))).alias("_mapping"))
    )
    restored = F.when(F.col("_mapping").isNull(), F.col(text)).otherwise(restore_text(text, "_mapping"))
    done = found.join(known, id_column, "left").withColumn(text, restored).drop("_tokens", "_mapping")
    return plain.unionByName(done)


def unstable_secrets(mapping: DataFrame, session: str = "session_id") -> DataFrame:
    """Secrets that got more than one placeholder within a session; none are expected."""
    return (
        mapping.groupBy(session, "secret")
        .agg(F.min("placeholder").alias("first"), F.max("placeholder").alias("last"))
        .where(F.col("first") != F.col("last"))
    )

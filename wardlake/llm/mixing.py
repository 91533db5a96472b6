"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weight's share of all words, at most `most` times its own size;
what is cut off goes to the other sources by weight. Every document of a source is then
taken target / size times: the whole part surely, the fraction by dependent rounding.
Two fractional documents meet, and a random amount of words moves from one to the other,
in the direction that keeps both expectations, until one of them is taken a whole number
of times. Words never get lost in a meeting, so a source misses its target by less than
one document. Documents meet in small groups, what is left of each group meets again in
a tree with a fan-in of `FAN_IN`, so no task ever holds a source.

Only built-in expressions are used. Randomness is a hash of the documents' keys: reruns
agree. Defined results: a null text has size 0 and is taken 0 times; a null source is a
source of its own and comes last; an empty table gives an empty result. Of n rows with
equal id, source and text, the whole part of their n fractions is taken surely, and what is
left is one document's fraction; which of them get a copy more is left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.expressions import let
from wardlake.llm.common import durable, joinable, unit_random, word_count

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
# Documents, or leftovers of groups, that meet in one group.
FAN_IN = 64
# A fraction this close to a whole number is one.
_EPSILON = 1e-9

_UNIT = "struct<doc_id:bigint,size:bigint,tag:bigint,weight:double,x:double>"
_DONE = "array<struct<doc_id:bigint,size:bigint,tag:bigint,extra:int>>"
_KEY = ["source", "doc_id", "size", "tag"]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, documents, target) of (source, source_size, documents) rows.

    The targets are least(most * size, level * weight) for the level that makes them add
    up to all words. Sources that reach their limit at a lower level are tried first.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("w", weight).withColumn("ratio", most * F.col("source_size") / F.col("w"))
    rising = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))
    left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", (F.sum("source_size").over(everything) - capped) / left)
    # The first level within its own source's limit, which is the largest such, is the one for all.
    fitting = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    level = levels.withColumn("common", fitting)
    return level.select(
        "source", "source_size", "documents",
        F.least(most * F.col("source_size").cast("double"), F.coalesce("common", F.lit(0.0)) * F.col("w")).alias("target"),
    )


def _meet(state: Column, unit: Column, seed: int) -> Column:
    """Let the open unit of a group meet the next one."""

    def settled(u: Column, x: Column) -> Column:
        return F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["tag"].alias("tag"), F.round(x).cast("int").alias("extra"))

    def moved(u: Column, x: Column) -> Column:
        return F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["tag"].alias("tag"), u["weight"].alias("weight"), x.alias("x")).cast(_UNIT)

    def whole(x: Column) -> Column:
        return (x < _EPSILON) | (x > 1 - _EPSILON)

    a, b = state["open"], unit

    def after(xa: Column, xb: Column) -> Column:
        # At least one of the two is whole; the other, if not, stays open.
        nothing = F.lit(None).cast(_UNIT)
        return F.struct(
            F.when(~whole(xa), moved(a, xa)).when(~whole(xb), moved(b, xb)).otherwise(nothing).alias("open"),
            F.concat(
                state["done"],
                F.when(whole(xa), F.array(settled(a, xa))).otherwise(F.array().cast(_DONE)),
                F.when(whole(xb), F.array(settled(b, xb))).otherwise(F.array().cast(_DONE)),
            ).cast(_DONE).alias("done"),
        )

    up = F.least((1 - a["x"]) * a["weight"], b["x"] * b["weight"])
    down = F.least(a["x"] * a["weight"], (1 - b["x"]) * b["weight"])
    chance = unit_random(a["doc_id"], a["size"], a["tag"], b["doc_id"], b["size"], b["tag"], F.lit(seed))
    # Words that move to a; each direction is as likely as the other one is long.
    step = let(F.struct(up.alias("up"), down.alias("down")), lambda t: F.when(chance * (t["up"] + t["down"]) < t["down"], t["up"]).otherwise(-t["down"]))
    met = let(
        step,
        lambda t: let(
            F.struct((a["x"] + t / a["weight"]).alias("a"), (b["x"] - t / b["weight"]).alias("b")), lambda x: after(x["a"], x["b"])
        ),
    )
    alone = F.struct(moved(b, b["x"]).alias("open"), state["done"].alias("done"))
    return F.when(a.isNull(), alone).otherwise(met)


def _round_groups(units: DataFrame, seed: int) -> DataFrame:
    """(source, grp, open, done) of units with source and grp; large documents meet first."""
    start = F.struct(F.lit(None).cast(_UNIT).alias("open"), F.array().cast(_DONE).alias("done"))
    listed = units.groupBy("source", "grp").agg(
        F.sort_array(F.collect_list(F.struct("weight", "doc_id", "size", "tag", "x")), asc=False).alias("units")
    )
    folded = F.aggregate("units", start, lambda state, unit: _meet(state, unit, seed))
    return listed.select("source", "grp", F.explode(F.array(folded)).alias("s")).select("source", "grp", "s.open", "s.done")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """One row per distinct (source, doc_id, size, tag) of docs, written.

    Each of its n rows is taken base times; `more` of them once more.
    """
    keys = docs.groupBy(*_KEY).agg(F.count("*").alias("n"))
    keys = durable(keys)
    per_source = keys.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.count("*").alias("documents"))
    targets = durable(source_targets(per_source, weights, most))
    most_docs = targets.agg(F.coalesce(F.max("documents"), F.lit(0))).first()[0]
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = keys.alias("d").join(joinable(targets).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.source", "doc_id", "size", "tag", "n", "source_size", "target", "documents", rate.alias("rate"), F.floor(rate + _EPSILON).alias("base")
    )
    rated = rated.withColumn("all", F.when(F.col("size") > 0, F.col("n") * F.greatest(F.col("rate") - F.col("base"), F.lit(0.0))).otherwise(F.lit(0.0)))
    rated = durable(rated.withColumn("sure", F.floor(F.col("all") + _EPSILON)))
    groups = F.ceil(F.col("documents") / FAN_IN)
    units = rated.where(F.col("all") - F.col("sure") > _EPSILON).select(
        *_KEY, F.col("size").cast("double").alias("weight"), (F.col("all") - F.col("sure")).alias("x"),
        F.pmod(F.xxhash64("doc_id", "size", "tag", F.lit(seed)), groups).alias("grp"),
    )
    settled = []
    width = -(-most_docs // FAN_IN)
    while True:
        rounds = durable(_round_groups(units, seed))
        settled.append(rounds.select("source", F.explode("done").alias("u")).select("source", "u.*"))
        if width <= 1:
            break
        width = -(-width // FAN_IN)
        units = rounds.where(F.col("open").isNotNull()).select(
            "source", "open.*", F.floor(F.col("grp") / FAN_IN).alias("grp")
        )
    extra = rounds.where(F.col("open").isNotNull()).select(
        "source", "open.doc_id", "open.size", "open.tag", F.round("open.x").cast("int").alias("extra")
    )
    for part in settled:
        extra = extra.unionByName(part)
    joined = rated.alias("r").join(extra.alias("e"), _same("r", "e"), "left")
    more = F.when(F.col("r.size") > 0, F.col("sure") + F.coalesce("extra", F.lit(0))).otherwise(0)
    base = F.when(F.col("r.size") > 0, F.least(F.col("base"), F.lit(most))).otherwise(0)
    return durable(joined.select(*(f"r.{c}" for c in _KEY), "n", "source_size", "target", base.cast("int").alias("base"), more.alias("more")))


def _same(left: str, right: str) -> Column:
    """Equal keys; nulls are equal to each other."""
    first, *rest = (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in _KEY)
    for condition in rest:
        first = first & condition
    return first


def apply(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """docs with source_size, target and copies; docs has the keys of the plan and any other columns.

    Equal rows of which only some get one more are numbered in parts, one per partition of
    their written form, so that a row that is repeated very often stays in many tasks.
    """
    carried = [f"d.{c}" for c in docs.columns]
    some = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    joined = docs.alias("d").join(planned.alias("p"), _same("d", "p"))
    whole = F.col("base") + (F.col("more") >= F.col("n")).cast("int")
    result = joined.where(~some).select(*carried, "source_size", "target", whole.cast("int").alias("copies"))
    open_ = planned.where(some)
    if open_.isEmpty():
        return result
    rows = docs.alias("d").join(open_.alias("p"), _same("d", "p")).select(
        *carried, "source_size", "target", "base", "more", F.monotonically_increasing_id().alias("__at")
    )
    rows = durable(rows)
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(*_KEY, part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*_KEY).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(counts.select(*_KEY, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    nth = F.row_number().over(Window.partitionBy(*_KEY, "__part").orderBy("__at"))
    placed = rows.withColumn("__part", part).withColumn("__nth", nth)
    numbered = placed.alias("d").join(joinable(offsets).alias("o"), _same("d", "o") & (F.col("d.__part") == F.col("o.__part")))
    one_more = (F.col("__before") + F.col("__nth") <= F.col("more")).cast("int")
    return result.unionByName(numbered.select(*carried, "source_size", "target", (F.col("base") + one_more).cast("int").alias("copies")))


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per row of (doc_id, source, size, tag)."""
    docs = durable(docs)
    return apply(docs, plan(docs, weights, most, seed)).select("doc_id", "source", "size", "source_size", "target", "copies")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *more: str) -> DataFrame:
    """(doc_id, source, size, tag) of every row, and more columns; size is the number of words, tag a hash of the text."""
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(text).alias("tag"), *more,
    )


def mix(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
    return copies(sized(docs, **columns)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Every row as often as the mix takes it, all columns as they were."""
    key = sized(docs.select(doc_id, text, source, F.struct("*").alias("__row")), doc_id, text, source, "__row")
    planned = plan(durable(key.drop("__row")), **options)
    taken = apply(key, planned.where("base > 0 or more > 0"))
    return taken.where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")

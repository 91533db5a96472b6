"""Kubernetes facts from an API request's method and path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.functions.expressions import ColumnLike, as_column, ascii_lower, ascii_upper, let


def k8s_verb(method: ColumnLike, named: Column) -> Column:
    """API verb of an HTTP method; GET is `get` on a named object, else `list`."""
    method = ascii_upper(as_column(method))
    return (
        F.when(method == "GET", F.when(named, "get").otherwise("list"))
        .when(method == "POST", "create")
        .when(method == "PUT", "update")
        .when(method == "PATCH", "patch")
        .when(method == "DELETE", "delete")
        .otherwise("")
    )


def k8s_facts(method: ColumnLike, path: ColumnLike) -> Column:
    """`struct<verb, resource, namespace>` of an API request."""
    method = as_column(method)
    segments = F.filter(
        F.split(F.substring_index(as_column(path), "?", 1), "/"), lambda s: s != ""
    )

    def below_prefix(parts: Column) -> Column:
        # Core paths start api/{version}, grouped ones apis/{group}/{version}.
        first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
        skipped = F.when(first == "api", 2).when(first == "apis", 3).otherwise(0)
        return F.slice(parts, skipped + 1, F.greatest(F.size(parts), F.lit(1)))

    def build(rest: Column) -> Column:
        depth = F.size(rest)
        head, second, third = (F.coalesce(F.get(rest, F.lit(i)), F.lit("")) for i in range(3))
        is_ns = head == "namespaces"
        namespaced = is_ns & (depth >= 3)
        named = F.when(namespaced, depth >= 4).when(is_ns, depth == 2).otherwise(depth >= 2)
        return F.struct(
            k8s_verb(method, named).alias("verb"),
            ascii_lower(F.when(namespaced, third).otherwise(head)).alias("resource"),
            F.when(namespaced, ascii_lower(second)).otherwise("").alias("namespace"),
        )

    return let(let(segments, below_prefix), build)

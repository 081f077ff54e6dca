"""Token estimators over JSON nodes (see ``functions.leaves.json_nodes``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leaf_units(nodes: Column) -> Column:
    """Strings a quarter of their characters (at least 1), numbers 1, the rest 0; at least 1 in all."""
    unit = lambda n: (
        F.when(n["kind"] == "string", F.greatest(F.lit(1), F.floor(F.char_length(n["text"]) / 4)))
        .when(n["kind"].isin("integer", "number"), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return F.greatest(F.lit(1).cast("bigint"), F.aggregate(nodes, F.lit(0).cast("bigint"), lambda a, n: a + unit(n)))


def json_units(compact: Column) -> Column:
    """A quarter of the bytes of the compact JSON text, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(compact) / 4).cast("int"))


def responses_units(nodes: Column) -> Column:
    """Only the ``input`` part of an object counts; every scalar is worth at least 1."""
    mine = F.filter(nodes, lambda n: (n["ptr"] == "/input") | F.startswith(n["ptr"], F.lit("/input/")))
    unit = lambda n: F.when(
        n["kind"] == "string", F.greatest(F.lit(1), F.floor(F.char_length(n["text"]) / 4))).otherwise(F.lit(1)).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, n: a + unit(n)))

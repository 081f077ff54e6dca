"""Labelled metrics over audit events: counters, histogram, exact percentiles, label checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Label vocabularies with their fallback, and histogram bounds in seconds.
ROUTES = ("/health", "/ready", "/metrics", "/v1/sanitize/evaluate", "/v1/chat/completions", "/v1/models",
          "/v1/responses", "/v1/mcp/tool-call", "/v1/mcp/tools/{toolName}/invoke")
VOCABULARY = {
    "route": (ROUTES, "other"),
    "path_class": (("runtime", "sanitization", "llm", "mcp"), "other"),
    "decision": (("allowed", "masked", "redacted", "blocked", "errored"), "errored"),
    "limit_decision": (("blocked", "dry_run"), "blocked"),
    "limit_kind": (("requests", "token_units"), "requests"),
    "profile": (("minimal", "strict", "custom"), "custom"),
    "block_reason": (("policy", "rate_limit", "runtime_draining", "invalid_request"), "policy"),
    "provider": (("openai", "anthropic", "mcp", "unknown"), "other"),
    "error_class": (("upstream_4xx", "upstream_5xx", "transport", "timeout"), "transport"),
    "auth_mode": (("static", "passthrough"), "unknown"),
    "auth_stage": (("gateway_auth", "upstream_credentials"), "other"),
    "auth_decision": (("pass", "fail"), "other"),
}
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)


def bounded(value: Column, label: str) -> Column:
    """A label value from its vocabulary, anything else in the fallback bucket."""
    known, fallback = VOCABULARY[label]
    return F.when(value.isin(*known), value).otherwise(fallback)


def status_class(status: Column) -> Column:
    return F.when(status.between(100, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).otherwise("other")


def normalize_route(path: Column) -> Column:
    invoke = F.startswith(path, F.lit("/v1/mcp/tools/")) & F.endswith(path, F.lit("/invoke"))
    return F.when(invoke, ROUTES[-1]).when(path.isin(*ROUTES[:-1]), path).otherwise("other")


def classify_path(path: Column) -> Column:
    return (
        F.when(path == "/v1/sanitize/evaluate", "sanitization")
        .when(path.isin("/v1/chat/completions", "/v1/models", "/v1/responses"), "llm")
        .when(F.startswith(path, F.lit("/v1/mcp")), "mcp")
        .otherwise("runtime")
    )


def decision_of(status: Column) -> Column:
    return F.when(status.between(200, 299), "allowed").when(status.isin(403, 429), "blocked").otherwise("errored")


def upstream_error_class(status: Column) -> Column:
    return F.when(status.between(400, 499), "upstream_4xx").when(status.between(500, 599), "upstream_5xx").otherwise("transport")


def counter(df: DataFrame, **labels: Column) -> DataFrame:
    """One row per label set; partial counts are combined before the shuffle."""
    return df.groupBy(*[c.alias(n) for n, c in labels.items()]).agg(F.count("*").alias("value"))


def histogram(df: DataFrame, seconds: Column, **labels: Column) -> DataFrame:
    """Cumulative buckets, sum and count per label set, one row per bucket."""
    v = F.greatest(seconds, F.lit(0.0))
    names = [*map(str, BUCKETS), "+Inf"]
    aggs = [F.count_if(v <= b).alias(f"_b{i}") for i, b in enumerate(BUCKETS)] + [F.count("*").alias("_b9")]
    wide = df.groupBy(*[c.alias(n) for n, c in labels.items()]).agg(*aggs, F.sum(v).alias("sum"), F.count("*").alias("count"))
    rows = F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"_b{i}").alias("bucket")) for i, n in enumerate(names)])
    return wide.select(*labels, "sum", "count", F.inline(rows))


#: Cuts of a group's values by which its ranks are looked for, and the accuracy of the sketch that places them.
CUTS, SKETCH = 256, 10_000


def nearest_rank(df: DataFrame, value: str, percents: list[int], by: str) -> DataFrame:
    """Exact nearest-rank percentiles: the value at index floor((n - 1) * p / 100); null values do not count.

    Equal values of a group are counted together first. A sketch of bounded size cuts each group into
    some hundred ranges; the ranges are counted exactly, and only the one that holds a rank is put in
    order. So no task holds a group, however large it is, and the sketch decides about work only.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    cuts = df.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("_g")).agg(F.percentile_approx(
        value, [k / CUTS for k in range(1, CUTS)], SKETCH).alias("_cuts"))
    placed = counts.join(cuts, F.col("_by").eqNullSafe(F.col("_g")), "left").withColumn(
        "_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_g", "_cuts")
    group = Window.partitionBy("_by")
    ranges = placed.groupBy("_by", "_range").agg(F.sum("_n").alias("_n")).withColumn(
        "_upto", F.sum("_n").over(group.orderBy("_range"))).withColumn("_total", F.sum("_n").over(group))
    index = F.floor((F.col("_total") - 1) * F.col("_p") / 100)
    wanted = ranges.withColumn("_p", F.explode(F.array(*map(F.lit, percents)))).filter(
        (index >= F.col("_upto") - F.col("_n")) & (index < F.col("_upto"))).select(
        F.col("_by").alias("_g"), F.col("_range").alias("_r"), "_p", (index - F.col("_upto") + F.col("_n")).alias("_index"))
    inside = Window.partitionBy("_by", "_range", "_p").orderBy("_v")
    ranked = placed.join(wanted, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r"))).withColumn(
        "_upto", F.sum("_n").over(inside)).filter(F.col("_upto") > F.col("_index"))
    return ranked.groupBy(F.col("_by").alias(by)).agg(*[
        F.min(F.when(F.col("_p") == p, F.col("_v"))).alias(f"p{p}") for p in percents])


def rfc3339_ms(ms: Column) -> Column:
    """Unix milliseconds as UTC text; the fraction is dropped when zero and loses trailing zeros."""
    base = F.date_format(F.timestamp_seconds(F.floor(ms / 1000)), "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.rtrim(F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"), F.lit("0"))
    text = F.concat(base, F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(""), F.lit("Z"))
    # years 0000 to 9999 can be written
    return F.when(ms.between(-62167219200000, 253402300799999), text).otherwise("invalid_unix_ms")


def missing_series(present: DataFrame, required: DataFrame) -> DataFrame:
    return required.join(present.select("series").distinct(), "series", "left_anti")

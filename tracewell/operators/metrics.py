"""Service metrics from request logs: counters, histograms, gauges, in-flight profiles, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.canonical import bounded_method, bounded_route, status_class
from tracewell.session import stored

# Histogram bounds in seconds and the declared metric families.
DURATION_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0)
FAMILIES = {
    "rag_http_requests_total": "counter",
    "rag_http_request_duration_seconds": "histogram",
    "rag_http_requests_in_flight": "gauge",
    "rag_health_checks_total": "counter",
    "rag_health_check_duration_seconds": "gauge",
    "rag_ready": "gauge",
    "rag_bulkhead_active": "gauge",
    "rag_bulkhead_rejections_total": "counter",
    "rag_ratelimit_rejections_total": "counter",
    "rag_boundary_duration_seconds": "histogram",
    "rag_downstream_failures_total": "counter",
    "rag_compensating_events_total": "counter",
}


def bounded_labels(log: DataFrame) -> DataFrame:
    """Request log with label values from closed sets: route template, known method, status class."""
    return (
        log.withColumn("route", bounded_route(F.col("route")))
        .withColumn("method", bounded_method(F.col("method")))
        .withColumn("status_class", status_class(F.col("status")))
    )


def _labels(names: tuple[str, ...]) -> Column:
    """Label map in name order."""
    if not names:
        return F.create_map().cast("map<string,string>")
    pairs = [part for name in sorted(names) for part in (F.lit(name), F.col(name).cast("string"))]
    return F.create_map(*pairs)


def label_text(labels: Column) -> Column:
    """``name="value"`` pairs joined by commas, in name order."""
    keys = F.sort_array(F.map_keys(labels))
    return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit('="'), labels[k], F.lit('"'))), ",")


def counters(rows: DataFrame, metric: str, *labels: str, value: str | None = None) -> DataFrame:
    """``(metric, labels, value)``: number of rows, or sum of ``value``, per label set."""
    total = F.sum(value) if value else F.count("*")
    counted = rows.groupBy(*labels).agg(total.cast("double").alias("value"))
    return counted.select(F.lit(metric).alias("metric"), _labels(labels).alias("labels"), "value")


def histogram(rows: DataFrame, metric: str, seconds: str, *labels: str) -> DataFrame:
    """Cumulative buckets in one pass: ``(metric, labels, le, bucket_count, sum, count)``; the last le is +Inf."""
    within = [F.count_if(F.col(seconds) <= bound).alias(f"le_{i}") for i, bound in enumerate(DURATION_BOUNDS)]
    totals = rows.groupBy(*labels).agg(*within, F.count(seconds).alias("count"), F.sum(seconds).alias("sum"))
    buckets = [
        F.struct(F.lit(i).alias("position"), F.lit(f"{bound:g}").alias("le"), F.col(f"le_{i}").alias("bucket_count"))
        for i, bound in enumerate(DURATION_BOUNDS)
    ]
    last = F.struct(F.lit(len(buckets)).alias("position"), F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count"))
    spread = totals.withColumn("bucket", F.explode(F.array(*buckets, last)))
    return spread.select(
        F.lit(metric).alias("metric"), _labels(labels).alias("labels"), "bucket.position", "bucket.le",
        "bucket.bucket_count", "sum", "count",
    )


def latest_gauge(rows: DataFrame, metric: str, value: str, ts: str, *labels: str) -> DataFrame:
    """Value of the latest sample per label set (the larger value among samples of one instant)."""
    latest = rows.groupBy(*labels).agg(F.max_by(value, F.struct(ts, value)).alias("value"))
    return latest.select(F.lit(metric).alias("metric"), _labels(labels).alias("labels"), "value")


def in_flight_profile(
    calls: DataFrame, start: str, end: str, boundary: str, bucket: str = "hour", piece: str = "minute"
) -> DataFrame:
    """Highest number of calls in flight per boundary and time bucket; a call ending at an instant makes room first.

    Starts and ends become net changes per instant before they are shuffled. The running sum is taken inside
    each ``piece`` and then over one total per piece, so a busy boundary is never sorted in one task.
    """
    edges = F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("change")),
                    F.struct(F.col(end).alias("at"), F.lit(-1).alias("change")))
    changes = calls.select(F.col(boundary).alias("boundary"), F.explode(edges).alias("edge"))
    instants = changes.groupBy("boundary", F.col("edge.at").alias("at")).agg(
        F.sum("edge.change").alias("change"), F.count_if(F.col("edge.change") > 0).alias("started")
    ).withColumn("piece", F.date_trunc(piece, "at"))
    running = Window.partitionBy("boundary", "piece").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    level = instants.withColumn("level", F.sum("change").over(running))
    pieces = level.groupBy("boundary", "piece").agg(
        F.max("level").alias("peak"), F.sum("change").alias("net"), F.sum("started").alias("started")
    )
    before = Window.partitionBy("boundary").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("net").over(before), F.lit(0))
    peaks = pieces.withColumn("most", F.greatest(base, base + F.col("peak")))
    return peaks.groupBy("boundary", F.date_trunc(bucket, "piece").alias("bucket")).agg(
        F.max("most").alias("max_in_flight"), F.sum("started").alias("started")
    )


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAMILIES.items()), "metric string, kind string")


def zero_filled(samples: DataFrame) -> DataFrame:
    """Every declared family, with value 0 and no labels where it has no sample yet.

    One outer join on the metric name: the samples are finished series, as few as there are label sets.
    """
    joined = families(samples.sparkSession).join(samples, "metric", "full")
    return joined.select(
        "metric", F.coalesce("kind", F.lit("counter")).alias("kind"),
        F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
    )


def exposition_order(samples: DataFrame) -> DataFrame:
    """Stable output order of metric families and label sets."""
    columns = [name for name in ("metric", "position") if name in samples.columns]
    return samples.withColumn("label_text", label_text(F.col("labels"))).orderBy(columns[0], "label_text", *columns[1:])


def readiness(required: DataFrame, checks: DataFrame) -> DataFrame:
    """Per target: are all required dependencies' latest checks ok? One that was never checked is not.

    ``required(target, dependency)``, ``checks(dependency, status, checked_at)``.
    """
    latest = checks.groupBy("dependency").agg(F.max_by("status", F.struct("checked_at", "status")).alias("status"))
    healthy = F.coalesce(F.col("status") == "ok", F.lit(False))
    return required.join(latest, "dependency", "left").groupBy("target").agg(
        F.bool_and(healthy).alias("ready"), F.count_if(~healthy).alias("unhealthy"), F.count("*").alias("required")
    )


REJECTIONS = {"BulkheadRejected": "rag_bulkhead_rejections_total", "RateLimitExceeded": "rag_ratelimit_rejections_total"}
_SERIES = "array<struct<metric:string,labels:array<struct<name:string,value:string>>,value:double,at:timestamp>>"


def log_samples(log: DataFrame, as_of: Column) -> DataFrame:
    """``(metric, labels, value, at)``: what each row of a service log adds to the metric families.

    ``log(route, method, status, seconds, ts, ended_at, boundary, operation, failure, dependency, check_name,
    check_status)``: a request, the call it makes across a boundary, and the health check it may be. ``failure`` is
    null, a rejection (:data:`REJECTIONS`) or the error of a call that was let through.
    """

    def sample(metric: str, value: Column | float, when: Column | None = None, **labels: Column) -> Column:
        pairs = [F.struct(F.lit(name).alias("name"), labels[name].cast("string").alias("value")) for name in sorted(labels)]
        value = F.lit(value) if isinstance(value, float) else value
        row = F.struct(
            F.lit(metric).alias("metric"), F.array(*pairs).cast("array<struct<name:string,value:string>>").alias("labels"),
            value.cast("double").alias("value"), F.col("ts").alias("at"))
        return row if when is None else F.when(when, row)

    boundary, failure, check = F.col("boundary"), F.col("failure"), F.col("check_name")
    rejected = F.coalesce(failure.isin(*REJECTIONS), F.lit(False))
    called = boundary.isNotNull() & ~rejected
    # Open at the time of the report: a call that ends at this instant has left.
    open_now = F.when((F.col("ts") <= as_of) & (F.col("ended_at") > as_of), 1.0).otherwise(0.0)
    samples = [
        sample("rag_http_requests_total", 1.0, route=F.col("route"), method=F.col("method"), status_class=F.col("status_class")),
        sample("rag_http_request_duration_seconds", F.col("seconds"), route=F.col("route"), method=F.col("method")),
        sample("rag_http_requests_in_flight", open_now),
        sample("rag_bulkhead_active", open_now, called, boundary=boundary),
        sample("rag_boundary_duration_seconds", F.col("seconds"), called, boundary=boundary, operation=F.col("operation")),
        sample("rag_downstream_failures_total", 1.0, called & failure.isNotNull(), boundary=boundary, dependency=F.col("dependency")),
        sample("rag_compensating_events_total", 1.0, boundary.isNotNull() & failure.isNotNull(), boundary=boundary, reason=failure),
        sample("rag_health_checks_total", 1.0, check.isNotNull(), check=check, status=F.col("check_status")),
        sample("rag_health_check_duration_seconds", F.col("seconds"), check.isNotNull(), check=check),
        sample("rag_ready", F.when(F.col("check_status") == "ok", 1.0).otherwise(0.0), check.isNotNull(), check=check),
        *[sample(metric, 1.0, boundary.isNotNull() & (failure == name), boundary=boundary) for name, metric in REJECTIONS.items()],
    ]
    return bounded_labels(log).select(F.inline(F.array_compact(F.array(*samples)).cast(_SERIES)))


def all_families(log: DataFrame, as_of: Column, required: tuple[str, ...]) -> DataFrame:
    """``(metric, kind, labels, le, value)``: every declared family from one pass over a service log.

    All samples meet in one aggregate per series whose parts merge per task: sum, number, latest and the counts within
    each bound; a series of any number of samples is no hot key. Readiness is 1 if the latest checks of all
    ``required`` dependencies are ok, and 0 if one was never checked.
    """
    within = [F.count_if(F.col("value") <= bound).alias(f"le_{i}") for i, bound in enumerate(DURATION_BOUNDS)]
    series = log_samples(log, as_of).groupBy("metric", "labels").agg(
        F.sum("value").alias("total"), F.count("value").alias("count"), F.max_by("value", F.struct("at", "value")).alias("latest"), *within)
    series = stored(series, "series")
    kind = F.create_map(*[F.lit(part) for pair in FAMILIES.items() for part in pair])[F.col("metric")]
    point = lambda suffix, le, value: F.struct(
        F.concat("metric", F.lit(suffix)).alias("metric"), F.lit(le).cast("string").alias("le"), value.cast("double").alias("value"))
    buckets = [point("_bucket", f"{bound:g}", F.col(f"le_{i}")) for i, bound in enumerate(DURATION_BOUNDS)]
    histogram = F.array(*buckets, point("_bucket", "+Inf", F.col("count")), point("_sum", None, F.coalesce("total", F.lit(0.0))), point("_count", None, F.col("count")))
    latest = F.col("metric") == "rag_health_check_duration_seconds"
    plain = F.array(point("", None, F.when(latest, F.col("latest")).otherwise(F.col("total"))))
    known = series.filter("metric <> 'rag_ready'").withColumn("kind", kind)
    points = known.select("kind", "labels", F.inline(F.when(F.col("kind") == "histogram", histogram).otherwise(plain)))
    labels = F.map_from_entries(F.transform("labels", lambda pair: F.struct(pair["name"], pair["value"])))
    none, no_labels = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    shaped = points.select("metric", "kind", labels.alias("labels"), "le", "value")
    # One row per check and per family: finished series, few beside the log.
    healthy = F.count_if(F.col("labels")[0]["value"].isin(*required) & (F.col("latest") == 1.0))
    family = F.regexp_replace("metric", "_(bucket|sum|count)$", "")
    seen = points.select(F.when(F.col("kind") == "histogram", family).otherwise(F.col("metric")).alias("metric")).distinct()
    ready = series.filter("metric = 'rag_ready'").agg((healthy == len(set(required))).cast("double").alias("value")).select(
        F.lit("rag_ready").alias("metric"), F.lit("gauge").alias("kind"), no_labels.alias("labels"), none.alias("le"), "value")
    empty = families(log.sparkSession).filter("metric <> 'rag_ready'").join(seen, "metric", "left_anti").select(
        "metric", "kind", no_labels.alias("labels"), none.alias("le"), F.lit(0.0).alias("value"))
    return shaped.unionByName(ready).unionByName(empty)

"""Queries: feedback in batch and as a stream, cold start."""

from pyspark.sql import functions as F

from cadenza import schemas, session
from cadenza.operators import (coldstart, entity_features, feedback as fb)
from cadenza.plans.registry import as_long, query, rounded
from cadenza.sources import (feedback_batches as batches, feedback_store,
                             sinks, testbed)
from cadenza.streaming import feedback_stream as fs, pair_state


def _rows(t):
    return fb.flatten(testbed.raw_feedback(t.spark, t.sf_dir))


def _feed(t):
    """The events file as a stream of feedback requests."""
    schema = testbed.table(t.spark, t.sf_dir, "events").schema
    events = fs.read_feed(t.spark, t.sf_dir, schema, "events.parquet")
    return testbed.feedback_requests(events)


def _read(t, path):
    return t.spark.read.parquet(path)


@query
def feedback_flatten(t):
    return _rows(t)


@query
def feedback_append(t):
    """Two appends to the monthly store, then counts per month."""
    path = session.scratch_path(t.spark, "feedback")
    rows = _rows(t)
    for accepted in (True, False):
        sinks.append_by_month(rows.filter(F.col("accepte") == accepted), path)
    return feedback_store.load_feedback(t.spark, path).groupBy(
        "date_visite_mois").agg(
        F.count("*").alias("n_items"),
        F.sum("quantite_finale").alias("total_qty"),
        F.countDistinct("client_id").alias("n_clients"))


@query
def feedback_load(t):
    """Stored feedback submitted from a date on."""
    path = session.scratch_path(t.spark, "feedback")
    sinks.append_by_month(_rows(t), path)
    stored = feedback_store.load_feedback(t.spark, path, "2024-01-15")
    return stored.orderBy("submitted_at")


@query
def feedback_batches(t):
    """Three batches, one of them sent twice, a month compacted, and what
    was submitted from a date on."""
    path = session.scratch_path(t.spark, "feedback")
    rows = session.write_and_read(_rows(t), "feedback-rows")
    part = F.pmod(F.dayofmonth("submitted_at"), F.lit(3))
    for number in (0, 1, 2, 1):
        batches.put(rows.filter(part == number), path, number)
    batches.compact(t.spark, path, "2024-01")
    return batches.load(t.spark, path, "2024-01-15")


@query
def feedback_stats(t):
    """Acceptance and modification rates per client, product and month."""
    rows = _rows(t)
    out = None
    for key in ("client_id", "code_article", "date_visite_mois"):
        part = fb.acceptance(rows, key).withColumnRenamed(
            key, "value").withColumn("level", F.lit(key))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "acceptance_rate", "modification_rate")


@query
def acceptance_windows(t):
    """Daily and sliding weekly rates, computed in batch."""
    rows = _rows(t)
    daily = fs.window_rates(rows, "1 day", watermark=None)
    weekly = fs.window_rates(rows, "7 days", "1 day", watermark=None)
    return rounded(daily.withColumn("kind", F.lit("day")).unionByName(
        weekly.withColumn("kind", F.lit("week"))), "acceptance_rate")


@query
def visit_sessions(t):
    return fb.sessions(_rows(t))


@query
def feedback_stream(t):
    """Stream the feed into the monthly table; read back per month."""
    path = fs.new_path(t.spark, "feedback")
    fs.ingest(_feed(t), path)
    return feedback_store.load_feedback(t.spark, path).groupBy(
        "date_visite_mois").agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("accepte")).alias("n_accepted"),
        F.sum("quantite_finale").alias("total_qty"))


@query
def acceptance_stream(t):
    """Daily windows closed by the watermark."""
    path = fs.new_path(t.spark, "rates")
    fs.run_to_files(fs.window_rates(fb.flatten(_feed(t)), "1 day"), path,
                    "acceptance")
    return rounded(_read(t, path), "acceptance_rate")


@query
def acceptance_week_stream(t):
    """Sliding weeks, a new one each day, closed by the watermark."""
    path = fs.new_path(t.spark, "weeks")
    fs.run_to_files(fs.window_rates(fb.flatten(_feed(t)), "7 days", "1 day"),
                    path, "acceptance-weeks")
    return rounded(_read(t, path), "acceptance_rate")


@query
def session_stream(t):
    """Sessions closed by the watermark."""
    path = fs.new_path(t.spark, "sessions")
    fs.run_to_files(fs.sessions(fb.flatten(_feed(t))), path, "sessions")
    return _read(t, path)


@query
def feedback_dedup(t):
    """Every request sent twice; resubmissions dropped on the stream."""
    path = fs.new_path(t.spark, "unique")
    twice = _feed(t).withColumn("_copy", F.explode(F.array(
        F.lit(1), F.lit(2)))).drop("_copy")
    fs.run_to_files(fs.drop_resubmissions(fb.flatten(twice)), path, "unique")
    return _read(t, path).groupBy("client_id").agg(
        F.count("*").alias("n_items"),
        F.sum("quantite_finale").alias("total_qty"))


@query
def pair_state_stream(t):
    """State per (client, product) after the whole feed, from the store."""
    path = fs.new_path(t.spark, "pairs")
    pair_state.run(fb.flatten(_feed(t)), path)
    return rounded(pair_state.live(t.spark, path), "avg_gap_days")


@query
def cold_start_neighbours(t):
    wanted = coldstart.new_clients(t.clients(), t.main_stage())
    known = entity_features.client_geo(t.main_stage()).filter("has_gps")
    return rounded(as_long(coldstart.nearest(known, wanted), "rang"),
                   "distance_km")


@query
def cold_start_clients(t):
    """Best sellers of the five nearest located clients."""
    wanted = coldstart.new_clients(t.clients(), t.main_stage())
    known = entity_features.client_geo(t.main_stage()).filter("has_gps")
    return as_long(coldstart.neighbour_best_sellers(
        coldstart.nearest(known, wanted), t.main_stage()), "rang")


@query
def cold_start_product_rows(t):
    """Newest products for regular buyers of their category, row by row."""
    return as_long(coldstart.new_product_rows(
        t.main_stage(), entity_features.product_profile(
            t.main_stage(), testbed.REFERENCE_DATE)),
        "rang", "days_since_first_order")


@query
def cold_start_products(t):
    return coldstart.new_product_targets(
        t.main_stage(), entity_features.product_profile(
            t.main_stage(), testbed.REFERENCE_DATE))

"""Streams over several batches, with late rows and a restart."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cadenza import schemas
from cadenza.operators import feedback as fb
from cadenza.streaming import feedback_stream as fs, pair_state

START = datetime(2024, 3, 1, 8)


def request(days, client="C1", accepted=True, quantity=2):
    at = START + timedelta(days=days)
    return (client, "R1", f"F{days}", at, at,
            [("P1", accepted, quantity, False)])


BATCHES = [
    [request(0), request(0.2, "C2"), request(1), request(2, "C2")],
    [request(5), request(3.5, accepted=False), request(6, "C2", False)],
    # within the watermark of two days, beyond it, and what closes the rest
    [request(4.5, "C3"), request(0.1, "C3"), request(12)],
]
TOO_LATE = 0.1


def feed(spark, folder):
    return fs.read_feed(spark, folder, schemas.FEEDBACK_REQUEST,
                        files_per_batch=1)


def write(spark, folder, number):
    """Files arrive in the order of their names and times."""
    spark.createDataFrame(BATCHES[number], schemas.FEEDBACK_REQUEST).coalesce(
        1).write.mode("append").parquet(folder)


def batch_rows(spark):
    rows = [r for batch in BATCHES for r in batch
            if r[3] != START + timedelta(days=TOO_LATE)]
    return fb.flatten(spark.createDataFrame(rows, schemas.FEEDBACK_REQUEST))


def run_twice(spark, tmp_path, start):
    """Two files, stop, a third file, and again from the checkpoint."""
    folder = str(tmp_path / "feed")
    for number in range(len(BATCHES)):
        write(spark, folder, number)
        if number:
            start(fb.flatten(feed(spark, folder)))


def same(stream, batch):
    columns = sorted(batch.columns)
    assert sorted(map(str, stream.select(columns).collect())) == sorted(
        map(str, batch.select(columns).collect()))


def test_sliding_windows_equal_batch(spark, tmp_path):
    path = str(tmp_path / "rates")
    run_twice(spark, tmp_path, lambda rows: fs.run_to_files(
        fs.window_rates(rows, "3 days", "1 day"), path, "weeks"))
    closed = fs.window_rates(batch_rows(spark), "3 days", "1 day",
                             watermark=None).filter(
        F.col("window_end") <= F.lit(START + timedelta(days=10)))
    same(spark.read.parquet(path), closed)


def test_ingest_keeps_late_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    run_twice(spark, tmp_path, lambda rows: fs.run_to_files(
        rows, path, "ingest", ["date_visite_mois"]))
    assert spark.read.parquet(path).count() == sum(map(len, BATCHES))


def test_update_tables_after_a_restart(spark, tmp_path):
    path = str(tmp_path / "state")
    run_twice(spark, tmp_path, lambda rows: fs.run_updates(
        fs.pair_state(rows), path, "pairs"))
    whole = fb.flatten(spark.createDataFrame(
        [r for batch in BATCHES for r in batch], schemas.FEEDBACK_REQUEST))
    same(fs.latest_state(spark, path), fs.pair_state(whole))


def test_keyed_state_after_a_restart_and_a_late_row(spark, tmp_path):
    path = str(tmp_path / "pairs")
    run_twice(spark, tmp_path, lambda rows: pair_state.run(rows, path))
    # the row behind the watermark is not in the state
    same(pair_state.live(spark, path), fs.pair_state(batch_rows(spark)))
    assert spark.read.parquet(path).count() == 0


def test_state_has_one_row_a_pair_however_many_batches(spark, tmp_path):
    folder, path = str(tmp_path / "feed"), str(tmp_path / "pairs")
    sent = []
    for day in range(5):
        sent += [request(day), request(day + 0.3), request(day, "C2")]
        spark.createDataFrame(sent[-3:], schemas.FEEDBACK_REQUEST).coalesce(
            1).write.mode("append").parquet(folder)
        pair_state.run(fb.flatten(feed(spark, folder)), path)
        assert pair_state.live(spark, path).count() == 2
    same(pair_state.live(spark, path), fs.pair_state(fb.flatten(
        spark.createDataFrame(sent, schemas.FEEDBACK_REQUEST))))


def test_an_idle_pair_ends_and_may_begin_again(spark, tmp_path):
    folder, path = str(tmp_path / "feed"), str(tmp_path / "pairs")
    for batch in ([request(0), request(1)], [request(9, "C2")],
                  [request(15, "C2")], [request(16)], [request(17, "C2")]):
        spark.createDataFrame(batch, schemas.FEEDBACK_REQUEST).coalesce(
            1).write.mode("append").parquet(folder)
        pair_state.run(fb.flatten(feed(spark, folder)), path, idle_days=5)
    first = START.date()
    ended = spark.read.parquet(path).collect()
    assert (ended[0].client_id, ended[0].n_orders, ended[0].total_qty,
            ended[0].first_date, ended[0].last_date) == (
        "C1", 2, 4, first, first + timedelta(1))
    live = {r.client_id: r.n_orders for r in pair_state.live(
        spark, path).collect()}
    assert live["C1"] == 1

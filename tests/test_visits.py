"""Visit features against a brute-force loop on a small skewed fixture."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.constants import SEASON_COEFFICIENTS
from cadenza.operators import increments, pair_features, ranking, visits
from cadenza.session import write_and_read


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(7)
    start = dt.date(2024, 11, 1)
    rows = []
    for invoice in range(60):
        client = "C0" if invoice % 2 else f"C{rng.randrange(1, 5)}"
        day = start + dt.timedelta(days=rng.randrange(0, 120))
        for _ in range(rng.randrange(1, 6)):
            product = "P0" if rng.random() < .6 else f"P{rng.randrange(1, 4)}"
            rows.append((client, product, f"F{invoice // 2}",
                         f"CO{invoice % 2}", day,
                         float(rng.choice([1, 1, 2, 5, 40])), day.month,
                         "CAT", "name"))
    return rows


@pytest.fixture(scope="module")
def main(spark, lines):
    return spark.createDataFrame(
        lines, "code_client string, code_article string, code_facture string,"
        " societe string, date_commande date, quantite double, mois int, "
        "categorie string, designation string")


def expected(lines, min_history=3):
    out = {}
    invoices = {(r[2], r[3]): (r[0], r[4]) for r in lines}
    for (number, company), (client, day) in invoices.items():
        history = sorted((r for r in lines if r[0] == client and r[4] < day),
                         key=lambda r: (r[4], r[5]))
        if len(history) < min_history:
            continue
        for product in {r[1] for r in history}:
            own = [r for r in history if r[1] == product]
            q = np.array([r[5] for r in own])
            days = [r[4] for r in own]
            gaps = [(b - a).days for a, b in zip(days, days[1:])]
            gap = max(np.mean(gaps) if gaps else 30.0, 1.0)
            half = len(q) // 2
            trend = 0.0 if len(q) < 2 else (
                q[half:].mean() - q[:half].mean()) / (q[:half].mean() + 1e-6)
            months = {}
            for r in own:
                months.setdefault(r[6], []).append(r[5])
            means = {m: np.mean(v) for m, v in months.items()}
            season = sum(SEASON_COEFFICIENTS[m] * v for m, v in means.items()
                         ) / max(sum(means.values()), 1)
            best = min(m for m in means if means[m] == max(means.values()))
            sold = [r[5] for r in lines if (r[2], r[3]) == (number, company)
                    and r[1] == product]
            recency = (day - days[-1]).days
            out[number, company, product] = (
                len(q), q.mean(), np.median(q), q.std(), q.min(), q.max(),
                q.sum(), q[-1], recency, gap, recency / gap, trend, season,
                best, SEASON_COEFFICIENTS[day.month], int(bool(sold)),
                sum(sold))
    return out


def test_equals_brute_force(main, lines):
    want = expected(lines)
    rows = visits.visit_dataset(main).collect()
    got = {(r.code_facture, r.societe, r.code_article): (
        r.frequency, r.avg_qty, r.median_qty, r.std_qty, r.min_qty, r.max_qty,
        r.total_qty, r.last_qty, r.recency_days, r.avg_delay_days,
        r.recency_relative, r.trend, r.avg_seasonal_coef, r.best_month,
        r.current_month_coef, r.target_bought, r.target_qty) for r in rows}
    assert len(rows) == len(got) and set(got) == set(want)
    for key, values in want.items():
        assert got[key] == pytest.approx(values), key


def test_no_feature_reads_the_visit_day_or_later(main):
    rows = visits.visit_dataset(main)
    assert rows.filter(F.col("recency_days") < 1).count() == 0
    asof = visits.state_before(main)
    assert asof.filter("last_date >= visit_date").count() == 0


def test_minimum_appearances(main, lines):
    want = sum(1 for v in expected(lines).values() if v[0] >= 2)
    assert visits.visit_dataset(main, min_appearances=2).count() == want


@pytest.mark.parametrize("known", [1, 2])
def test_bought_rows_are_those_of_the_whole_set(main, known):
    whole = visits.visit_dataset(main, min_appearances=known)
    own = visits.visit_dataset(main, min_appearances=known, bought=True)
    want = sorted(map(str, whole.filter("target_bought = 1").collect()))
    assert want and sorted(map(str, own.collect())) == want


def test_bought_rows_are_built_without_the_others(spark, main):
    """States meet the sales of their pair, not the client's days."""
    text = visits.visit_dataset(main, bought=True)._jdf.queryExecution(
    ).optimizedPlan().toString()
    assert "explode" not in text


def test_bought_rows_of_mixed_invoices_and_lines_without_day(spark):
    """Invoices of several days, copies, lines without a day."""
    rng, rows = random.Random(3), []
    for i in range(400):
        day = rng.choice([None] + [dt.date(2024, 1, d) for d in range(1, 15)])
        rows.append((f"C{rng.randrange(3)}", f"P{rng.randrange(4)}",
                     f"F{rng.randrange(60)}", "CO1", day,
                     float(rng.randrange(1, 9)), day and day.month, "CAT",
                     "name"))
    table = spark.createDataFrame(
        rows, "code_client string, code_article string, code_facture string,"
        " societe string, date_commande date, quantite double, mois int, "
        "categorie string, designation string")
    whole = visits.visit_dataset(table)
    want = sorted(map(str, whole.filter("target_bought = 1").collect()))
    assert want and sorted(map(str, visits.visit_dataset(
        table, bought=True).collect())) == want


def test_gaps_keep_every_line(main, lines):
    rows = pair_features.gaps(main).collect()
    assert sum(r.n_lines for r in rows) == len(lines)
    assert sum(r.n_lines for r in rows if r.date_diff is None) == len(
        {r[:2] for r in lines})


def test_matrix_agrees_with_single_features(main):
    keys = pair_features.PAIR
    full = pair_features.pair_matrix(main, "2025-06-01", {"CO0": 0, "CO1": 1})
    single = (pair_features.quantity_stats(main)
              .join(pair_features.cadence(main, "2025-06-01").select(
                  *keys, "avg_delay_days", "recency_relative"), keys)
              .join(pair_features.trends(main), keys)
              .join(pair_features.last_quantity(main), keys)
              .join(pair_features.best_month(main), keys)
              .join(pair_features.both_deviations(main), keys))
    left = {(r.code_client, r.code_article): r for r in full.collect()}
    for r in single.collect():
        row = left.pop((r.code_client, r.code_article))
        for name in ("avg_qty", "median_qty", "total_qty", "frequency",
                     "avg_delay_days", "recency_relative", "trend",
                     "last_qty", "best_month"):
            assert row[name] == pytest.approx(r[name]), name
        assert row.std_qty == pytest.approx(r.std_qty_matrix)
    assert not left


def test_long_histories_equal_arrays(spark, monkeypatch):
    """Medians by ranges of quantities, and by arrays, of the same pairs."""
    main = spark.range(900).select(
        F.concat(F.lit("C"), F.pmod(F.hash("id"), F.lit(3)))
        .alias("code_client"), F.lit("P").alias("code_article"),
        F.date_add(F.lit("2023-01-01"), F.pmod(F.hash("id", F.lit(1)),
                                               F.lit(200)))
        .alias("date_commande"),
        (F.pmod(F.hash("id", F.lit(2)), F.lit(37)) / 3).alias("quantite"))
    results = []
    for limit in (10 ** 9, 0):
        monkeypatch.setattr(visits, "ARRAY_ENTRIES", limit)
        rows = visits.pair_states(main)
        results.append(sorted(
            (r["code_client"], r["_day"], r["frequency"],
             round(r["median_qty"], 9), round(r["trend"], 9),
             round(r["std_qty"], 9)) for r in rows.collect()))
    assert results[0] == results[1] and len(results[0]) > 400


def test_increments_equal_the_whole_build(spark, lines, main):
    """A base and two increments, one of them with late lines."""
    whole = {(r.code_facture, r.societe, r.code_article): r
             for r in visits.visit_dataset(main).collect()}
    days = sorted({r[4] for r in lines})
    cuts = days[len(days) // 3], days[2 * len(days) // 3]
    state, got = None, {}
    for low, high in ((None, cuts[0]), (cuts[0], cuts[1]), (cuts[1], None)):
        part = main
        if low:
            part = part.filter(F.col("date_commande") > F.lit(low))
        if high:
            part = part.filter(F.col("date_commande") <= F.lit(high))
        again = main.filter(F.col("date_commande") == F.lit(days[0]))
        built = increments.extend(
            state, part if state is None else part.union(again),
            write_and_read)
        if state is not None:
            assert built.late.count() == again.count() > 0
        state = built.state
        assert state.count() == state.select(
            "code_client", "code_article").distinct().count()
        for r in built.rows.collect():
            key = (r.code_facture, r.societe, r.code_article)
            assert key not in got
            got[key] = r
    assert set(got) == set(whole)
    for key, r in got.items():
        for name, value in whole[key].asDict().items():
            assert r[name] == pytest.approx(value) if isinstance(
                value, float) else r[name] == value, (key, name)


def test_an_increment_does_not_read_old_lines(spark, lines, main):
    """The tail of a state holds half of a pair's lines, its counts all."""
    state = increments.extend(None, main, write_and_read).state
    sizes = {}
    for r in lines:
        sizes[r[:2]] = sizes.get(r[:2], 0) + 1
    for r in state.collect():
        n = sizes[(r.code_client, r.code_article)]
        assert r._lines == n == sum(e.n for e in r._hist)
        assert sum(e.n for e in r._tail) == n - n // 2
        assert len({e.q for e in r._hist}) == len(r._hist)


def test_latest_rows_are_counted_without_building_all_visits(spark, main):
    """The last rows and reorder rates of the whole set, undated and long
    minimum histories included, from a plan that spreads nothing."""
    rows = write_and_read(main.withColumn("date_commande", F.when(
        F.pmod(F.xxhash64("code_article", "date_commande"), F.lit(9)) > 0,
        F.col("date_commande"))), "undated")
    for n in (1, 2, 3):
        whole = ranking.latest_with_rate(visits.visit_dataset(
            rows, min_appearances=n))
        latest = visits.latest_dataset(rows, write_and_read,
                                       min_appearances=n)
        plan = latest._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan
        short = ranking.latest_with_rate(latest)
        assert sorted(short.columns) == sorted(whole.columns)
        want, got = [{(r.code_client, r.code_article): r for r in d.select(
            short.columns).collect()} for d in (whole, short)]
        assert set(got) == set(want) and len(want) > 10
        for key, r in want.items():
            for mine, theirs in zip(got[key], r):
                assert mine == (pytest.approx(theirs) if isinstance(
                    theirs, float) else theirs), key


def rows_of(df):
    return sorted(df.collect(), key=lambda r: tuple(map(str, r[:4])))


def test_visits_apart_give_the_same_rows(spark, main, monkeypatch):
    """Days with many visits, and invoices of several days or clients, are
    joined; others are found in the calendar."""
    built = rows_of(visits.visit_dataset(main))
    asked = rows_of(visits.targets(main))
    assert visits.place_visits(main).apart is None
    monkeypatch.setattr(visits, "DAY_VISITS", 0)
    assert visits.place_visits(main).apart.count() == 60
    assert rows_of(visits.visit_dataset(main)) == built
    assert rows_of(visits.targets(main)) == asked


def test_invoice_of_two_days_keeps_its_sales(spark, main):
    """It stands on its first day, with what it sold on both."""
    line = main.filter("code_client = 'C0'").orderBy(
        F.desc("date_commande")).limit(1)
    first, number = line.first(), F.lit("F-two")
    more = line.unionByName(line.withColumn("date_commande", F.date_add(
        "date_commande", 1))).withColumn("code_facture", number)
    rows = visits.targets(main.unionByName(more)).filter(
        F.col("code_facture") == number).collect()
    sold = {r.code_article: r.target_qty for r in rows if r.target_bought}
    assert {r.visit_date for r in rows} == {first.date_commande}
    assert sold == {first.code_article: 2 * first.quantite}


def test_built_rows_are_not_shuffled(main):
    """Rows of the training set move only as states of a pair, by client."""
    for built in (visits.visit_dataset(main), visits.targets(main)):
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert "visit_date" not in "".join(
            line for line in plan.splitlines()
            if "Exchange hashpartitioning(code_client" in line
            and "code_article" not in line.split("ENSURE")[0])
        assert "hashpartitioning(code_facture" not in plan


def test_targets_are_the_sales_of_candidates(spark, main):
    """Also of lines without a day, of several quantities."""
    undated = main.filter("code_article = 'P0'").withColumns({
        "date_commande": F.lit(None).cast("date"), "code_facture": F.concat(
            F.lit("N"), "code_facture")})
    for lines in (main, main.unionByName(undated)):
        want = visits.candidates(lines).join(visits.sold(lines), [
            *visits.VISIT, "code_article"], "left").select(
            *visits.VISIT, *pair_features.PAIR, "visit_date",
            F.col("_sold").isNotNull().cast("int").alias("target_bought"),
            F.coalesce("_sold", F.lit(0.0)).alias("target_qty"))
        assert rows_of(visits.targets(lines)) == rows_of(want)

"""Leak-free visit-level training set.

A visit is an invoice.  Its candidates are the products the client bought on
an earlier day, and every feature reads earlier days only, so features depend
on (client, product, day) and not on the invoice.  The work is therefore:

1. count lines per (pair, day, quantity) -- map-side combine;
2. one running window per pair over those counts; the last row of a day is the
   pair's state after that day, valid until the pair's next day;
3. hand each state to the client's visits inside its validity, found by
   position in the client's sorted day list -- no range join, no row pairs
   that are thrown away, and per client at most one day list bounded by the
   calendar;
4. what a visit sold of a product are lines of the pair on the last day of a
   state's validity, so that a state brings them along.

Rows of the training set are therefore not shuffled once they are built.  Only
visits of several days or clients, and those of a client's day that has very
many, are joined to them (``place_visits``).

Cost grows with lines plus output rows.  A pair or client holding a third of
all lines enters the windows as at most days x distinct quantities rows; the
median of a long history is found by ranges of quantities, which spread it.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza import constants as C
from cadenza.functions import calendar as cal, quantities as qty
from cadenza.operators.pair_features import (
    PAIR, _early_quantity, _ordered, _positions, _running, first_maximum,
    gap_mean, order_counts, variance)
from cadenza.session import write_and_read, write_by_key

VISIT = ["code_facture", "societe"]


def visits(main: DataFrame) -> DataFrame:
    """One row per invoice (number and company)."""
    first = F.min(F.struct("date_commande", "code_client"))
    return main.groupBy(*VISIT).agg(first.alias("_v")).select(
        *VISIT, F.col("_v.code_client").alias("code_client"),
        F.col("_v.date_commande").alias("visit_date"))


def client_days(main: DataFrame, extra: dict[str, Column] | None = None,
                ) -> DataFrame:
    """Lines and quantity per client and day, with totals of earlier days."""
    extra = extra or {}
    days = main.groupBy("code_client", "date_commande").agg(
        F.count("*").alias("_n"), F.sum("quantite").alias("_q"),
        *[c.alias(k) for k, c in extra.items()])
    earlier = (Window.partitionBy("code_client").orderBy("date_commande")
               .rowsBetween(Window.unboundedPreceding, -1))
    return days.select(
        "code_client", F.col("date_commande").alias("visit_date"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("history_lines"),
        F.coalesce(F.sum("_q").over(earlier), F.lit(0.0))
        .alias("history_qty"),
        F.max("date_commande").over(earlier).alias("history_last_date"),
        *extra)


def visit_history(main: DataFrame) -> DataFrame:
    """Every visit with the totals of the client's strictly earlier lines."""
    return visits(main).join(client_days(main), ["code_client", "visit_date"])


def eligible_visits(main: DataFrame,
                    min_history: int = C.MIN_HISTORY_LINES) -> DataFrame:
    return (visit_history(main)
            .filter(F.col("history_lines") >= min_history)
            .select(*VISIT, "code_client", "visit_date", "history_lines"))


def _calendar(main: DataFrame, min_history: int) -> DataFrame:
    """Per client the sorted list of its days and the first eligible one.

    History only grows, so the eligible days are a tail of the list.
    """
    return client_days(main).groupBy("code_client").agg(
        F.sort_array(F.collect_list("visit_date")).alias("_days"),
        F.min(F.when(F.col("history_lines") >= min_history,
                     F.col("visit_date"))).alias("_from"),
    ).filter(F.col("_from").isNotNull())


def _spread(states: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per state and visit day in (state day, next state day]."""
    days = F.col("_days")
    start = F.greatest(F.array_position(days, F.col("_day")) + 1,
                       F.array_position(days, F.col("_from")))
    stop = F.when(F.col("_until").isNull(), F.size(days)).otherwise(
        F.array_position(days, F.col("_until")))
    length = (stop - start + 1).cast("int")
    return (states.join(calendar, "code_client")
            .withColumn("_length", length)
            .filter(F.col("_length") > 0)
            .withColumn("visit_date", F.explode(
                F.slice(days, start.cast("int"), F.col("_length"))))
            .drop("_days", "_from", "_until", "_length"))


#: Visits of a client's day up to which they stand in its calendar.
DAY_VISITS = 16


@dataclass(frozen=True)
class Placed:
    """Lines with ``_sale`` (invoice, company, quantity), null on lines of
    the visits ``apart``; None if there are no such visits."""
    lines: DataFrame
    apart: DataFrame | None


def place_visits(main: DataFrame) -> Placed:
    """Mark the lines whose visits may be found from their client and day.

    Apart are visits of several days or clients, and those of a client's day
    that has more than ``DAY_VISITS``, so that a calendar stays short.
    """
    at = F.struct("date_commande", "code_client")
    found = main.groupBy(*VISIT).agg(
        F.min(at).alias("_v"),
        (~F.min(at).eqNullSafe(F.max(at))).alias("_mixed")).select(
        *VISIT, "_v.code_client", F.col("_v.date_commande")
        .alias("visit_date"), "_mixed")
    many = F.count(F.lit(1)).over(Window.partitionBy(
        "code_client", "visit_date")) > DAY_VISITS
    apart = write_and_read(found.withColumn("_many", many).filter(
        "_mixed OR _many").drop("_mixed", "_many"), "visits-apart")
    sale = F.struct(*VISIT, "quantite")
    if apart.isEmpty():  # an optimization only: the join would mark all lines
        return Placed(main.withColumn("_sale", sale), None)
    keys = apart.select([F.col(c).alias(f"_a_{c}") for c in VISIT]).withColumn(
        "_apart", F.lit(True))
    marked = main.join(keys, reduce(Column.__and__, [
        F.col(c).eqNullSafe(F.col(f"_a_{c}")) for c in VISIT]), "left")
    return Placed(marked.withColumn("_sale", F.when(
        F.col("_apart").isNull(), sale)).select(*main.columns, "_sale"), apart)


def day_list() -> dict[str, Column]:
    """The invoices of a client's day, from lines with ``_sale``."""
    return {"_on": F.collect_set(F.when(
        F.col("_sale").isNotNull(), F.struct(*VISIT)))}


def visit_calendar(days: DataFrame, min_history: int) -> DataFrame:
    """Per client its sorted days, the first eligible one, ``_list`` of its
    visits in their order and for each day their number ``_upto`` it.

    ``days`` has code_client, visit_date, history_lines and ``_on``.
    """
    run = Window.partitionBy("code_client").orderBy("visit_date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return days.filter("visit_date IS NOT NULL").withColumn(
        "_upto", F.sum(F.size("_on")).over(run)).groupBy("code_client").agg(
        F.sort_array(F.collect_list(F.struct("visit_date", "_upto", "_on")))
        .alias("_c"),
        F.min(F.when(F.col("history_lines") >= min_history,
                     F.col("visit_date"))).alias("_from"),
    ).filter(F.col("_from").isNotNull()).select(
        "code_client", F.col("_c.visit_date").alias("_days"), "_from",
        F.col("_c._upto").alias("_upto"), F.flatten(F.transform(
            "_c", lambda day: F.transform(day["_on"], lambda v: F.struct(
                day["visit_date"].alias("visit_date"),
                *[v[c].alias(c) for c in VISIT])))).alias("_list"))


def on_visits(states: DataFrame, calendar: DataFrame, placed: Placed,
              main: DataFrame) -> DataFrame:
    """One row per state and visit in (state day, next state day], with what
    the visit sold.

    ``_sales`` of a state are its pair's lines on the next state's day.
    """
    days, upto = F.col("_days"), F.col("_upto")
    start = F.greatest(F.array_position(days, F.col("_day")) + 1,
                       F.array_position(days, F.col("_from")))
    stop = F.when(F.col("_until").isNull(), F.size(days)).otherwise(
        F.array_position(days, F.col("_until")))
    before = F.coalesce(F.get(upto, (start - 2).cast("int")), F.lit(0))
    length = F.get(upto, (stop - 1).cast("int")) - before
    own = [c for c in states.columns if c not in ("_until", "_sales")]
    spread = states.join(calendar, "code_client").withColumns({
        "_before": F.when(start.isNotNull(), before).cast("int"),
        "_length": F.when(start.isNotNull(), length).cast("int")}).filter(
        F.col("_length") > 0).select(*own, "_until", "_sales", F.inline(
            F.slice("_list", F.col("_before") + 1, F.col("_length"))))
    hits = F.filter("_sales", lambda s: reduce(Column.__and__, [
        s[c] == F.col(c) for c in VISIT]))
    total = F.aggregate(hits, F.lit(None).cast("double"), lambda a, s: (
        F.coalesce(a + s["quantite"], a, s["quantite"])))
    rows = spread.withColumn("_sold", F.when(
        F.col("visit_date") == F.col("_until"), total)).drop(
        "_until", "_sales")
    if placed.apart is None:
        return rows
    others = _spread(states.drop("_sales"), calendar.drop(
        "_upto", "_list")).join(placed.apart, ["code_client", "visit_date"])
    return rows.unionByName(others.join(
        sold(main), [*VISIT, "code_article"], "left"))


def _weighted_median(entries: Column, lines: Column) -> Column:
    """Median of (quantity, count) entries; plain pick while counts are 1."""
    ordered = F.array_sort(entries)
    low, high = F.floor((lines + 1) / 2), F.floor(lines / 2) + 1

    def step(acc, e):
        upto = acc["seen"] + e["n"]
        def keep(rank, old):
            return F.when((acc["seen"] < rank) & (rank <= upto),
                          e["q"]).otherwise(old)
        return F.struct(upto.alias("seen"),
                        keep(low, acc["low"]).alias("low"),
                        keep(high, acc["high"]).alias("high"))

    zero = F.struct(F.lit(0).cast("long").alias("seen"),
                    F.lit(None).cast("double").alias("low"),
                    F.lit(None).cast("double").alias("high"))
    walked = F.aggregate(ordered, zero, step,
                         lambda a: (a["low"] + a["high"]) / 2)
    picked = (F.get(ordered, (low - 1).cast("int"))["q"]
              + F.get(ordered, (high - 1).cast("int"))["q"]) / 2
    return F.when(F.size(entries) == lines, picked).otherwise(walked)


def _first_lines(entries: Column, lines: Column) -> Column:
    """Quantity of the first ``lines`` lines of (quantity, count) entries."""
    start = F.struct(lines.cast("long").alias("left"),
                     F.lit(0.0).alias("sum"))

    def step(acc, e):
        taken = F.least(e["n"], acc["left"])
        return F.struct((acc["left"] - taken).alias("left"),
                        (acc["sum"] + e["q"] * taken).alias("sum"))
    return F.aggregate(entries, start, step, lambda a: a["sum"])


def _early_sums(states: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``_early``: the quantity of each state's first ``_half`` lines.

    ``_half`` only grows with the day.  Entries stand at the number of lines
    before them and states at their half, in one order per pair; the last
    entry before a state holds the line in question.
    """
    run = _running()
    lines, total = F.sum("n").over(run), F.sum(
        F.col("quantite") * F.col("n")).over(run)
    entries = counts.withColumns({"_lines": lines, "_total": total}).select(
        *PAIR, (F.col("_lines") - F.col("n")).alias("_half"), F.struct(
            (F.col("_lines") - F.col("n")).alias("start"),
            (F.col("_total") - F.col("quantite") * F.col("n"))
            .alias("before"), F.col("quantite").alias("q")).alias("_entry"))
    both = states.unionByName(entries, allowMissingColumns=True)
    before = Window.partitionBy(*PAIR).orderBy(
        "_half", F.col("_entry").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_entry", True).over(before))
    early = F.col("_found.before") + F.col("_found.q") * (
        F.col("_half") - F.col("_found.start"))
    return found.filter("_entry IS NULL").withColumn(
        "_early", F.coalesce(early, F.lit(0.0))).drop("_entry", "_found")


def _prefix_counts(asked: DataFrame, counts: DataFrame, keys: list[str],
                   ) -> DataFrame:
    """Add ``_upto`` to (keys, day): the lines of the keys up to the day."""
    both = asked.withColumn("_asked", F.lit(True)).unionByName(
        counts.groupBy(*keys, "date_commande").agg(
            F.sum("n").alias("n"), F.max("quantite").alias("quantite")),
        allowMissingColumns=True)
    run = Window.partitionBy(*keys).orderBy(
        "date_commande", F.col("_asked").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return both.withColumns({
        "_upto": F.coalesce(F.sum("n").over(run), F.lit(0)),
        "_value": F.max("quantite").over(Window.partitionBy(*keys)),
    }).filter("_asked").drop("_asked", "n", "quantite")


def _long_medians(counts: DataFrame) -> DataFrame:
    """(pair, day, median) of pairs with long histories.

    The distinct quantities of a pair are numbered and cut into ranges, about
    as many as each holds.  Per day the range that holds the middle line is
    found from the ranges' counts up to the day, and inside it the quantity.
    A pair of D days and Q quantities costs about D x sqrt(Q) rows, spread
    over its ranges.
    """
    pair = Window.partitionBy(*PAIR)
    indexed = counts.withColumn("_index", F.dense_rank().over(
        pair.orderBy("quantite")) - 1).withColumn(
        "_number", F.max("_index").over(pair) + 1).withColumn(
        "_width", F.ceil(F.sqrt("_number")).cast("int")).withColumns({
            "_range": F.floor(F.col("_index") / F.col("_width")).cast("int"),
            "_place": (F.col("_index") % F.col("_width")).cast("int")})
    days = indexed.groupBy(*PAIR, "date_commande").agg(
        F.sum("n").alias("_n"), F.first("_width").alias("_width"),
        F.first("_number").alias("_number"))
    lines = F.sum("_n").over(pair.orderBy("date_commande").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    middle = days.withColumn("_lines", lines).withColumn(
        "_rank", F.explode(F.array(F.floor((F.col("_lines") + 1) / 2),
                                   F.floor(F.col("_lines") / 2) + 1)))
    day = [*PAIR, "date_commande", "_rank"]

    def first_reaching(asked: DataFrame, keys: list[str], at: str,
                       extra: list[str]) -> DataFrame:
        """The first ``at`` whose counts reach the rank, per day and rank."""
        upto = _prefix_counts(asked, indexed, keys)
        run = Window.partitionBy(*day).orderBy(at).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        total = F.sum("_upto").over(run)
        return upto.withColumn("_total", total).filter(
            F.col("_total") >= F.col("_rank")).groupBy(*day, *extra).agg(
            F.min(F.struct(at, (F.col("_total") - F.col("_upto"))
                           .alias("below"), F.col("_value").alias("value")))
            .alias("_hit"))

    # a day with an odd number of lines asks for one rank, not twice the same
    asked = middle.distinct().withColumn("_range", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("_number") - 1) / F.col("_width"))
        .cast("int"))))
    ranges = first_reaching(asked, [*PAIR, "_range"], "_range", ["_width"])
    inside = ranges.select(
        *PAIR, "date_commande", F.col("_rank").alias("_whole"),
        (F.col("_rank") - F.col("_hit.below")).alias("_rank"),
        F.col("_hit._range").alias("_range"), F.explode(F.sequence(
            F.lit(0), F.col("_width") - 1)).alias("_place"))
    day.append("_whole")
    picked = first_reaching(inside, [*PAIR, "_range", "_place"], "_place", [])
    return picked.groupBy(*PAIR, "date_commande").agg(
        F.avg("_hit.value").alias("median_qty"))


#: Entries (day and quantity) of a pair up to which its history is handled
#: as one array per day; longer ones take the way of ``_long_medians``.
ARRAY_ENTRIES = 256


def pair_states(main: DataFrame) -> DataFrame:
    """State of every pair after each of its days, valid until ``_until``."""
    return _states_of(pair_counts(main, {}))


def pair_counts(main: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """Counted lines, laid out by pair: all windows below read them as they
    lie.  ``_size`` is the number of the pair's counts."""
    counts = order_counts(main, extra).repartition(*PAIR)
    return write_by_key(counts.withColumn("_size", F.count(F.lit(1)).over(
        Window.partitionBy(*PAIR))), "pair-counts", PAIR)


def _states_of(written: DataFrame) -> DataFrame:
    sales = [c for c in written.columns if c == "_sales"]
    counts = written.select(*PAIR, "date_commande", "quantite", "n", "_size",
                            *sales)
    short = counts.filter(F.col("_size") <= ARRAY_ENTRIES).drop("_size")
    long = counts.filter(F.col("_size") > ARRAY_ENTRIES).drop("_size")
    entries = F.flatten(F.collect_list("_de").over(
        Window.partitionBy(*PAIR).orderBy("date_commande").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)))
    bounded = _states(short, {"_de": F.sort_array(F.collect_list(F.struct(
        F.col("quantite").alias("q"), F.col("n").alias("n"))))},
        {"_entries": entries}).withColumn("median_qty", _weighted_median(
            F.col("_entries"), F.col("frequency"))).drop("_entries", "_de")
    if long.isEmpty():  # an optimization only: the branch would be empty
        return bounded
    medians = _long_medians(long.drop("_sales")).withColumnRenamed("date_commande", "_day")
    unbounded = _states(long, {}, {}).join(medians, [*PAIR, "_day"])
    return bounded.unionByName(unbounded)


def _states(counts: DataFrame, per_day: dict[str, Column],
            running: dict[str, Column]) -> DataFrame:
    """All of a state but its median, from (pair, day, quantity, n)."""
    q, n = F.col("quantite"), F.col("n")
    # deviations are summed from the pair's smallest quantity on, see
    # pair_features.pair_matrix; any constant gives the same deviation
    above = F.col("_above")
    sales = "_sales" in counts.columns
    if sales:
        per_day = per_day | {"_now": F.flatten(F.collect_list("_sales"))}
    days = counts.withColumn(
        "_above", q - F.min(q).over(Window.partitionBy(*PAIR))).groupBy(
        *PAIR, "date_commande").agg(
        F.sum(n).alias("_dn"), F.sum(q * n).alias("_dq"),
        F.sum(above * n).alias("_da"),
        F.sum(above * above * n).alias("_ds"), F.min(q).alias("_dmin"),
        F.max(q).alias("_dmax"),
        *[c.alias(name) for name, c in per_day.items()])
    ordered = Window.partitionBy(*PAIR).orderBy("date_commande")
    run = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = {
        "frequency": F.sum("_dn").over(run),
        "total_qty": F.sum("_dq").over(run),
        "_above_sum": F.sum("_da").over(run),
        "_squares": F.sum("_ds").over(run),
        "min_qty": F.min("_dmin").over(run),
        "max_qty": F.max("_dmax").over(run),
        "_first": F.min("date_commande").over(run),
        "_until": F.lead("date_commande").over(ordered),
    }
    if sales:
        running = running | {"_sales": F.lead("_now").over(ordered)}
    for m in C.SEASON_COEFFICIENTS:
        here = F.month("date_commande") == m
        totals[f"_q{m}"] = F.sum(F.when(here, F.col("_dq"))).over(run)
        totals[f"_n{m}"] = F.sum(F.when(here, F.col("_dn"))).over(run)
    after_day = days.withColumns(totals | running).withColumn(
        "_half", F.floor(F.col("frequency") / 2)).drop("_now")
    if "_entries" in running:
        after_day = after_day.withColumn("_early", _first_lines(
            F.col("_entries"), F.col("_half")))
    else:
        after_day = _early_sums(after_day, counts.drop("_sales"))
    return _state_features(after_day.withColumnsRenamed(
        {"date_commande": "_day", "_dmax": "last_qty"}),
        "_until", *[c for c in per_day if c != "_now"], *running)


def _state_features(sums: DataFrame, *others: str) -> DataFrame:
    """The columns of a state but its median, from sums over its lines."""
    freq, total = F.col("frequency"), F.col("total_qty")
    means = [(F.col(f"_q{m}") / F.col(f"_n{m}"), m)
             for m in C.SEASON_COEFFICIENTS]
    mean_sum = sum((F.coalesce(v, F.lit(0.0)) for v, _ in means), F.lit(0.0))
    weighted = sum((F.coalesce(v * F.lit(C.SEASON_COEFFICIENTS[m]),
                               F.lit(0.0)) for v, m in means), F.lit(0.0))
    spread = variance(freq, F.col("_above_sum"), F.col("_squares"), freq)
    gap = F.coalesce(gap_mean(F.col("_first"), F.col("_day"), freq),
                     F.lit(C.DEFAULT_GAP_DAYS))
    return sums.select(
        *PAIR, "_day",
        (total / freq).alias("avg_qty"),
        F.sqrt(spread).alias("std_qty"), F.greatest(
            freq * F.col("_squares") - F.col("_above_sum")
            * F.col("_above_sum"), F.lit(0.0)).alias("qty_dispersion"),
        "min_qty", "max_qty", "total_qty",
        "frequency", "last_qty",
        F.greatest(gap, F.lit(1.0)).alias("avg_delay_days"),
        qty.trend(F.col("_early"), F.col("_half"), total, freq)
        .alias("trend"),
        (weighted / F.greatest(mean_sum, F.lit(1.0)))
        .alias("avg_seasonal_coef"),
        first_maximum(means).alias("best_month"), *others)


def order_states(main: DataFrame) -> DataFrame:
    """The classifier's features of each pair after each of its days."""
    return pair_states(main).drop("_until")


def state_before(main: DataFrame) -> DataFrame:
    """Narrow as-of: count, last quantity and last day before each visit day."""
    return _narrow_states(main).drop("first_date")


def _counted_states(rows: DataFrame, *others: str) -> DataFrame:
    """Count, last quantity and first day of a pair after each of its days,
    from its counted lines."""
    run = _running()
    return rows.withColumns({
        "frequency": F.sum("n").over(run),
        "first_date": F.min("date_commande").over(run),
        "_until": F.lead("date_commande").over(_ordered()),
    }).filter(F.col("_until").isNull()
              | (F.col("_until") > F.col("date_commande"))).select(
        *PAIR, F.col("date_commande").alias("_day"), "_until", "frequency",
        F.col("quantite").alias("last_qty"), "first_date", *others)


def _sold_states(lines: DataFrame) -> DataFrame:
    """Counted states with the pair's sales on the next state's day."""
    day = Window.partitionBy(*PAIR, "date_commande")
    rows = order_counts(lines, {"_sales": F.collect_list("_sale")})
    # in the order of the other windows, so that rows are sorted once
    rows = rows.withColumn("_row", F.row_number().over(_ordered())).withColumn(
        "_now", F.flatten(F.collect_list("_sales").over(day))).withColumn(
        "_sales", F.lead("_now").over(_ordered()))
    return _counted_states(rows, "_sales")


def _narrow_states(main: DataFrame) -> DataFrame:
    states = _counted_states(order_counts(main))
    return _spread(states, _calendar(main, 1)).select(
        *PAIR, "visit_date", "frequency", "last_qty",
        F.col("_day").alias("last_date"), "first_date")


def timed_targets(main: DataFrame, min_history: int = C.MIN_HISTORY_LINES,
                  min_appearances: int = C.MIN_PRODUCT_APPEARANCES,
                  ) -> DataFrame:
    """Targets with the relative recency alone: no median and no month sums
    are built for it."""
    states = _narrow_states(main).filter(
        F.col("frequency") >= min_appearances)
    gap = F.coalesce(gap_mean(F.col("first_date"), F.col("last_date"),
                              F.col("frequency")), F.lit(C.DEFAULT_GAP_DAYS))
    since = F.datediff("visit_date", "last_date").cast("double")
    known = states.select(*PAIR, "visit_date", (since / F.greatest(
        gap, F.lit(1.0))).alias("recency_relative"))
    rows = eligible_visits(main, min_history).join(
        known, ["code_client", "visit_date"]).join(
        sold(main), [*VISIT, "code_article"], "left")
    return rows.select(
        *VISIT, *PAIR, "visit_date", "recency_relative",
        F.col("_sold").isNotNull().cast("int").alias("target_bought"))


def _first_names(counts: DataFrame) -> DataFrame:
    """Category and designation of the pair's first line."""
    first = F.min(F.struct("date_commande", "_name"))
    return counts.groupBy(*PAIR).agg(first.alias("_f")).select(
        *PAIR, F.col("_f._name.categorie").alias("categorie"),
        F.col("_f._name.designation").alias("designation"))


def _named_counts(main: DataFrame,
                  extra: dict[str, Column] | None = None) -> DataFrame:
    return pair_counts(main, {"_name": F.min(F.struct(
        "categorie", "designation")), **(extra or {})})


def _named_states(counts: DataFrame, min_appearances: int) -> DataFrame:
    """States with first names, of pairs known well enough."""
    states = _states_of(counts).join(_first_names(counts), PAIR)
    if min_appearances > 1:
        states = states.filter(F.col("frequency") >= min_appearances)
    return states


def _at_visit(rows: DataFrame) -> DataFrame:
    """Add what depends on the day of the visit to states."""
    days = F.datediff("visit_date", "_day")
    return (rows
            .withColumn("recency_days", days.cast("double"))
            .withColumn("recency_relative",
                        F.col("recency_days") / F.col("avg_delay_days"))
            .withColumn("current_month_coef", cal.season_coefficient(
                F.month("visit_date"), default=F.lit(1.0)))
            .drop("_day"))


def sold(main: DataFrame) -> DataFrame:
    """Quantity of every product on every invoice."""
    return main.groupBy(*VISIT, "code_article").agg(
        F.sum("quantite").alias("_sold"))


def visit_dataset(main: DataFrame, min_history: int = C.MIN_HISTORY_LINES,
                  min_appearances: int = C.MIN_PRODUCT_APPEARANCES,
                  bought: bool = False) -> DataFrame:
    """One row per (visit, candidate product) with features and targets.

    ``bought`` gives the rows with ``target_bought`` = 1 only, and builds no
    others.
    """
    if bought:
        return _at_visit(_at_sales(
            _named_counts(main), main, min_history, min_appearances)).select(
            *_dataset_columns())
    placed = place_visits(main)
    states = _named_states(_named_counts(placed.lines, {
        "_sales": F.collect_list("_sale")}), min_appearances)
    calendar = visit_calendar(client_days(placed.lines, day_list()), min_history)
    return _at_visit(on_visits(states, calendar, placed, main)).select(
        *_dataset_columns())


def _at_sales(counts: DataFrame, main: DataFrame, min_history: int,
              min_appearances: int) -> DataFrame:
    """The state before each sale of a pair on an eligible visit.

    What an invoice of one client and day sold is a line of the pair on that
    day, so that its state is the one that ends there, and pairs of a single
    count have none.  Invoices of several days or clients look for theirs.
    """
    start = client_days(main).groupBy("code_client").agg(F.min(F.when(
        F.col("history_lines") >= min_history, F.col("visit_date")))
        .alias("_from"))
    at = F.struct("date_commande", "code_client")
    mixed = main.groupBy(*VISIT).agg(
        (~F.min(at).eqNullSafe(F.max(at))).alias("_mixed"),
        F.min(at).alias("_v")).select(
        *VISIT, "_v.code_client", F.col("_v.date_commande")
        .alias("visit_date"), "_mixed")
    eligible = mixed.join(start, "code_client").filter(
        F.col("visit_date") >= F.col("_from")).drop("_from")
    sales = write_and_read(sold(main).join(eligible, VISIT), "sales")
    plain, mixed = [sales.filter(c).drop("_mixed") for c in (
        "NOT _mixed", "_mixed")]
    found = _named_states(counts.filter("_size > 1"), min_appearances).filter(
        "_until IS NOT NULL").withColumnRenamed("_until", "visit_date").join(
        plain, [*PAIR, "visit_date"])
    if mixed.isEmpty():  # an optimization only: the branch would be empty
        return found
    placed = _last_days(mixed.select(*PAIR, "visit_date").distinct(), counts)
    on = [F.col(f"s.{c}") == F.col(f"p.{c}") for c in PAIR]
    states = _named_states(counts, min_appearances).drop("_until").alias("s")
    others = states.join(placed.alias("p"), reduce(
        Column.__and__, on, F.col("s._day").eqNullSafe(F.col("p._at")))
    ).select("s.*", "p.visit_date").join(mixed, [*PAIR, "visit_date"])
    return found.unionByName(others)


def _last_days(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``_at`` to (pair, visit_date): the pair's last day before it.

    Asked days stand among the pair's days; a line without a day comes
    before all.
    """
    days = counts.select(*PAIR, F.col("date_commande").alias("_day")
                         ).distinct()
    before = Window.partitionBy(*PAIR).orderBy(
        F.coalesce("visit_date", "_day"), F.col("visit_date").isNull()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return asked.unionByName(days, allowMissingColumns=True).withColumn(
        "_at", F.max("_day").over(before)).filter(
        "visit_date IS NOT NULL").drop("_day")


def _dataset_columns() -> list:
    return [
        *VISIT, *PAIR, "categorie", "designation", "avg_qty", "median_qty",
        "std_qty", "qty_dispersion", "min_qty", "max_qty", "total_qty",
        "frequency", "last_qty", "recency_days", "avg_delay_days", "recency_relative", "trend",
        "avg_seasonal_coef", "best_month", "current_month_coef", "visit_date",
        F.col("_sold").isNotNull().cast("int").alias("target_bought"),
        F.coalesce("_sold", F.lit(0.0)).alias("target_qty")]


def candidates(main: DataFrame, min_history: int = C.MIN_HISTORY_LINES,
               min_appearances: int = C.MIN_PRODUCT_APPEARANCES) -> DataFrame:
    """Known products of every eligible visit."""
    known = state_before(main).filter(
        F.col("frequency") >= min_appearances).select(
        *PAIR, "visit_date", F.col("frequency").alias("appearances"))
    return eligible_visits(main, min_history).join(
        known, ["code_client", "visit_date"])


def targets(main: DataFrame, min_history: int = C.MIN_HISTORY_LINES,
            min_appearances: int = C.MIN_PRODUCT_APPEARANCES) -> DataFrame:
    """Known products of every eligible visit, and what it sold of them."""
    placed = place_visits(main)
    states = _sold_states(placed.lines).filter(
        F.col("frequency") >= min_appearances)
    # a client without an earlier line knows no product
    calendar = visit_calendar(client_days(placed.lines, day_list()),
                              max(min_history, 1))
    states = states.select(*PAIR, "_day", "_until", "_sales")
    rows = on_visits(states.filter("_day IS NOT NULL"), calendar, placed, main)
    if not main.filter("date_commande IS NULL").isEmpty():
        # lines without a day come before all and know no next day
        undated = states.filter("_day IS NULL").drop("_sales")
        rows = rows.unionByName(_spread(undated, calendar.drop(
            "_upto", "_list")).join(
            visits(main), ["code_client", "visit_date"]).join(
            sold(main), [*VISIT, "code_article"], "left"))
    return rows.select(
        *VISIT, *PAIR, "visit_date",
        F.col("_sold").isNotNull().cast("int").alias("target_bought"),
        F.coalesce("_sold", F.lit(0.0)).alias("target_qty"))


def summary(main: DataFrame, min_history: int = C.MIN_HISTORY_LINES,
            min_appearances: int = C.MIN_PRODUCT_APPEARANCES) -> DataFrame:
    """Visits skipped and rows built, in one row."""
    rows = targets(main, min_history=min_history,
                   min_appearances=min_appearances)
    per_visit = rows.groupBy(*VISIT).agg(
        F.count("*").alias("_rows"), F.sum("target_bought").alias("_bought"))
    joined = visit_history(main).join(per_visit, VISIT, "left")
    eligible = F.col("history_lines") >= min_history
    return joined.agg(
        F.count("*").alias("visits_total"),
        F.count_if(~eligible).alias("skipped_no_history"),
        F.count_if(eligible & F.col("_rows").isNull())
        .alias("skipped_no_candidates"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_built"),
        F.coalesce(F.sum("_bought"), F.lit(0)).alias("positives"),
    ).withColumn("positive_rate", F.try_divide(
        F.col("positives") * 100.0, F.col("rows_built")))


def client_visits(main: DataFrame,
                  min_history: int = C.MIN_HISTORY_LINES) -> DataFrame:
    """Per client with an eligible visit: the first eligible day ``_from``,
    the last visit, and ``_days``, the number of visits of each day."""
    start = client_days(main).groupBy("code_client").agg(F.min(F.when(
        F.col("history_lines") >= min_history, F.col("visit_date")))
        .alias("_from"))
    days = visits(main).groupBy("code_client", "visit_date").agg(
        F.count("*").alias("n"), F.max(F.struct(*VISIT)).alias("_last"))
    whole = days.groupBy("code_client").agg(
        F.max(F.struct("visit_date", "_last")).alias("_v"),
        F.collect_list(F.struct("visit_date", "n")).alias("_days"))
    return whole.join(start, "code_client").filter(
        F.col("_v.visit_date") >= F.col("_from")).select(
        "code_client", "_from", "_v.visit_date", "_v._last.*", "_days")


def _pair_sales(main: DataFrame) -> DataFrame:
    """(pair, visit day): visits that sold the product, and the sale of the
    last of them."""
    return sold(main).join(visits(main), VISIT).groupBy(
        *PAIR, F.col("visit_date").alias("_sale_day")).agg(
        F.count("*").alias("_sales"),
        F.max(F.struct(*VISIT, "_sold")).alias("_sale"))


def latest_dataset(main: DataFrame, stage,
                   min_history: int = C.MIN_HISTORY_LINES,
                   min_appearances: int = C.MIN_PRODUCT_APPEARANCES,
                   ) -> DataFrame:
    """The last row of every pair in ``visit_dataset``, with the number of
    its rows there, ``n_visits``, and of those that bought, ``n_bought``.

    A pair once known is a candidate of every later visit, so its last row
    is that of the client's last visit and its state that of all lines
    before it: one aggregate per pair over lines and sales.  The rows of
    earlier visits are counted, not built.  ``stage`` (``write_and_read``)
    writes one row per client, which is read twice.
    """
    day, q, n = F.col("date_commande"), F.col("quantite"), F.col("n")
    clients = stage(client_visits(main, min_history), "client-visits")
    rows = order_counts(main, {"_name": F.min(F.struct(
        "categorie", "designation"))}).unionByName(
        _pair_sales(main), allowMissingColumns=True).join(
        clients.drop("_days"), "code_client").filter(
        day.isNull() | (day < F.col("visit_date")))
    # a line without a day comes before all visits
    first_day = F.coalesce(day, F.lit("0001-01-01").cast("date"))
    # sales come first in their pair's order and count no lines
    placed = _positions(rows.fillna({"n": 0})).withColumns({
        "_above": q - F.min(q).over(Window.partitionBy(*PAIR)),
        "_after": F.min(F.when(
            (n > 0) & (F.col("_before") + n >= min_appearances),
            first_day)).over(
            Window.partitionBy(*PAIR)),
        "_w": q * n, "_early": _early_quantity()})
    per_month = {}
    for m in C.SEASON_COEFFICIENTS:
        here = F.month(day) == m
        per_month[f"_q{m}"] = F.sum(F.when(here, F.col("_w")))
        per_month[f"_n{m}"] = F.sum(F.when(here, n))
    counted = ((F.col("_sale_day") > F.col("_after"))
               & (F.col("_sale_day") >= F.col("_from")))
    last_sale = reduce(Column.__and__, [
        F.col(f"_sale.{c}") == F.col(c) for c in VISIT])
    visit = ["visit_date", *VISIT]
    stats = placed.groupBy(*PAIR).agg(
        F.sum(n).alias("frequency"), F.sum("_w").alias("total_qty"),
        F.sum(F.col("_above") * n).alias("_above_sum"),
        F.sum(F.col("_above") * F.col("_above") * n).alias("_squares"),
        F.min(q).alias("min_qty"), F.max(q).alias("max_qty"),
        F.percentile(q, 0.5, n).alias("median_qty"),
        F.max(F.struct(day, q))["quantite"].alias("last_qty"),
        F.min(day).alias("_first"), F.max(day).alias("_day"),
        F.sum("_early").alias("_early"),
        F.min(F.when(n > 0, F.struct(day, "_name")))["_name"].alias("_name"),
        F.first("_after").alias("_after"),
        F.coalesce(F.sum(F.when(counted, F.col("_sales"))), F.lit(0))
        .alias("n_bought"),
        F.max(F.when(last_sale, F.col("_sale._sold"))).alias("_sold"),
        *[F.first(c).alias(c) for c in visit],
        *[c.alias(k) for k, c in per_month.items()])
    # a pair without enough lines before the visit is no candidate
    states = _state_features(stats.filter("_after IS NOT NULL").withColumn(
        "_half", F.floor(F.col("frequency") / 2)), "median_qty", "_name",
        "_after", "n_bought", "_sold", *visit)
    seen = F.aggregate("_days", F.lit(0).cast("long"), lambda total, d: F.when(
        (d["visit_date"] > F.col("_after")) & (d["visit_date"] >= F.col(
            "_from")), total + d["n"]).otherwise(total))
    full = _at_visit(states).withColumns({
        "categorie": F.col("_name.categorie"),
        "designation": F.col("_name.designation")}).join(
        clients.select("code_client", "_from", "_days"), "code_client")
    return full.select(*_dataset_columns(), seen.alias("n_visits"),
                       "n_bought")


def positives(dataset: DataFrame) -> DataFrame:
    return dataset.filter(F.col("target_qty") > 0)

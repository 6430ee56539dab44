"""Proposals for clients without history and for newly launched products."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.operators.pair_features import PAIR

EARTH_KM = 6371.0
LEVELS = 19  # cell width 360 / 2^level degrees, about 150 m at the finest


def haversine_km(lat1: Column, lng1: Column, lat2: Column,
                 lng2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = (F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2)
         * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _cells(level: Column) -> Column:
    return F.pow(F.lit(2), level).cast("long")


def _width(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _x(lng: Column, level: Column) -> Column:
    return F.pmod(F.floor((lng + 180) / _width(level)), _cells(level))


def _y(lat: Column, level: Column) -> Column:
    return F.floor((lat + 90) / _width(level))


def _around(centre: Column, reach: Column, count: Column) -> Column:
    """Cell columns within ``reach`` of ``centre`` on a ring of ``count``."""
    return F.array_distinct(F.transform(
        F.sequence(-reach, reach), lambda d: F.pmod(centre + d, count)))


def nearest(known: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """The k known clients nearest to each wanted client; exact.

    Both have code_client, latitude, longitude.  Each wanted point picks the
    finest grid level whose 3 x 3 block of cells holds k known points; those
    bound the search radius, and only the cells that radius can reach are
    joined.  Dense areas are thus searched on fine cells.  Of known clients at
    one exact place only the k first codes can matter; the rest are dropped
    before anything is paired.
    """
    place = Window.partitionBy("latitude", "longitude").orderBy("code_client")
    points = (known.withColumn("_at", F.row_number().over(place))
              .filter(F.col("_at") <= k)
              .select(F.col("code_client").alias("neighbour"),
                      F.col("latitude").alias("_lat"),
                      F.col("longitude").alias("_lng")))
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    placed = points.withColumn("_level", levels).withColumns({
        "_cx": _x(F.col("_lng"), F.col("_level")),
        "_cy": _y(F.col("_lat"), F.col("_level"))})
    filled = placed.groupBy("_level", "_cx", "_cy").agg(
        F.count("*").alias("_n"))

    asked = wanted.select("code_client", "latitude", "longitude")
    level = F.col("_level")
    block = (asked.withColumn("_level", levels)
             .withColumn("_cx", F.explode(_around(
                 _x(F.col("longitude"), level), F.lit(1), _cells(level))))
             .withColumn("_cy", F.explode(F.transform(
                 F.sequence(F.lit(-1), F.lit(1)),
                 lambda d: _y(F.col("latitude"), level) + d)))
             .join(filled, ["_level", "_cx", "_cy"])
             .groupBy("code_client", "_level").agg(F.sum("_n").alias("_n"))
             .groupBy("code_client")
             .agg(F.max(F.when(F.col("_n") >= k, level)).alias("_fine")))
    placed_asked = asked.join(block, "code_client").withColumn(
        "_level", F.coalesce("_fine", F.lit(0)))
    # k points lie within two cell widths each way, so within this arc
    arc = F.lit(8.0 ** 0.5) * _width(level)
    polar = F.abs("latitude") + arc
    spread = F.when(polar < 89.0, arc / F.cos(F.radians(polar))).otherwise(
        F.lit(360.0))
    reach = F.least(F.ceil(spread / _width(level)),
                    F.floor(_cells(level) / 2) + 1)
    targets = (placed_asked
               .withColumn("_cx", F.explode(_around(
                   _x(F.col("longitude"), level), reach, _cells(level))))
               .withColumn("_cy", F.explode(F.transform(
                   F.sequence(F.lit(-3), F.lit(3)),
                   lambda d: _y(F.col("latitude"), level) + d))))
    pairs = targets.join(placed, ["_level", "_cx", "_cy"]).filter(
        F.col("neighbour") != F.col("code_client")).withColumn(
        "distance_km", haversine_km(F.col("latitude"), F.col("longitude"),
                                    F.col("_lat"), F.col("_lng")))
    order = Window.partitionBy("code_client").orderBy(
        "distance_km", "neighbour")
    return (pairs.withColumn("rang", F.row_number().over(order))
            .filter(F.col("rang") <= k)
            .select("code_client", "neighbour", "rang", "distance_km"))


def new_clients(clients: DataFrame, main: DataFrame) -> DataFrame:
    """Located (client, company) pairs without an invoice at that company."""
    return clients.filter(F.col("latitude").isNotNull()).join(
        main.select("code_client", "societe").distinct(),
        ["code_client", "societe"], "left_anti")


def neighbour_best_sellers(neighbours: DataFrame, main: DataFrame,
                           k: int = 5) -> DataFrame:
    """Products the neighbours bought most, best k per new client."""
    totals = main.groupBy(*PAIR).agg(
        F.sum("quantite").alias("_q")).withColumnRenamed(
        "code_client", "neighbour")
    bought = neighbours.join(totals, "neighbour").groupBy(
        "code_client", "code_article").agg(
        F.sum("_q").alias("total_qty"), F.count("*").alias("n_neighbours"))
    order = Window.partitionBy("code_client").orderBy(
        F.desc("total_qty"), "code_article")
    return (bought.withColumn("rang", F.row_number().over(order))
            .filter(F.col("rang") <= k))


def new_product_targets(main: DataFrame, products: DataFrame,
                        min_orders: int = 3) -> DataFrame:
    """Regular buyers of a category with that category's new products.

    One row per (client, category) and the list of new products, instead of a
    row per client and product.
    """
    launched = products.filter("is_new_product").groupBy("categorie").agg(
        F.array_join(F.sort_array(F.collect_list("code_article")), ",")
        .alias("new_products"), F.count("*").alias("n_new_products"))
    return regular_buyers(main, min_orders).join(launched, "categorie")


def new_product_rows(main: DataFrame, products: DataFrame,
                     per_client: int = 5, min_orders: int = 3) -> DataFrame:
    """The newest products of the categories that a client buys regularly.

    One row per client and product, ``per_client`` at most: a category's
    products are cut to as many before they meet its buyers, so that a
    category full of launches does not multiply them.
    """
    newest = [F.asc("days_since_first_order"), F.asc("code_article")]
    launched = products.filter("is_new_product").select(
        "categorie", "code_article", "days_since_first_order",
        F.row_number().over(Window.partitionBy("categorie").orderBy(*newest))
        .alias("_n")).filter(F.col("_n") <= per_client).drop("_n")
    rows = regular_buyers(main, min_orders).join(launched, "categorie")
    order = Window.partitionBy("code_client").orderBy(
        *newest[:1], F.desc("n_orders"), newest[1])
    return rows.withColumn("rang", F.row_number().over(order)).filter(
        F.col("rang") <= per_client)


def regular_buyers(main: DataFrame, min_orders: int = 3) -> DataFrame:
    """(client, category) with at least so many invoices."""
    orders = main.select("code_client", "categorie", "code_facture",
                         "societe").distinct()
    return orders.groupBy("code_client", "categorie").agg(
        F.count("*").alias("n_orders")).filter(
        F.col("n_orders") >= min_orders)

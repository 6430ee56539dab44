"""Components of the links between members of shared buckets.

Members that share a bucket are candidates; a test decides which pairs are
links.  Components need not see every pair: a pair inside one component
tells nothing new.  Pairs are therefore tested in rounds.

1. Each member meets one member of each of its buckets, chosen by a hash.
2. In buckets that still span several components, each member meets a few
   members more.
3. In buckets that still do, the members outside the largest component meet
   all members of other components: as pairs in small buckets, and block by
   block in large ones, where only links leave the meeting of two blocks.

After the third round every untested pair lies inside one component, so the
components are those of all links among candidates.  A bucket of n linked
members costs about n tests, not n squared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.llm.common import Scratch, bounded, connected_components

#: Best partners of a member that the first and second round test.
FIRST_PARTNERS, SECOND_PARTNERS = 4, 8
#: Members of a bucket that the second round offers as partners.
SECOND_PIVOTS = 4
#: Members of a small bucket, and about the members of a block.
BLOCK = 64


def shared_buckets(scratch: Scratch, members: DataFrame) -> DataFrame:
    """The rows (bucket, id, ..) whose bucket holds two ids or more.

    An id is in a bucket once.
    """
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    shared = scratch.stage(shared.where("n > 1").select("bucket"),
                           "shared-buckets")
    return members.join(bounded(shared), "bucket")


def components(scratch: Scratch, members: DataFrame,
               near: Callable[[Callable, Callable], tuple[Column, Column]],
               test: Callable[[DataFrame], DataFrame],
               evidence: DataFrame,
               linked: Callable[[Column, Column], Column]) -> DataFrame:
    """(id, comp) for the ids with a link; comp is the smallest linked id.

    ``members`` (bucket, id, and what ``near`` needs) is a written table of
    shared buckets with the same other columns on every row of an id.
    ``near(a, b)`` gives a condition that every link fulfils and a distance,
    from functions that name the columns of either side.  ``test`` keeps the
    linked ones of distinct pairs (a, b), a < b; ``linked`` is the same test
    on two members as structs, with the columns that ``evidence`` has by id.
    """
    payload = [c for c in members.columns if c not in ("bucket", "id")]

    def meet(left: DataFrame, right: DataFrame, best: int | None,
             known: list[str]) -> DataFrame:
        condition, distance = near(lambda c: F.col(f"l.{c}"),
                                   lambda c: F.col(f"r.{c}"))
        on = ((F.col("l.bucket") == F.col("r.bucket"))
              & (F.col("l.id") != F.col("r.id")) & condition)
        if known:
            on = on & (F.col("l.comp") != F.col("r.comp"))
        pairs = left.alias("l").join(right.alias("r"), on).select(
            F.col("l.id").alias("x"), F.col("r.id").alias("y"),
            distance.alias("far")).distinct()
        if best:
            order = Window.partitionBy("x").orderBy("far", "y")
            pairs = pairs.withColumn("n", F.row_number().over(order)).where(
                F.col("n") <= best)
        return pairs.select(F.least("x", "y").alias("a"),
                            F.greatest("x", "y").alias("b")).distinct()

    def chosen(rows: DataFrame, seed: int, number: int) -> DataFrame:
        order = Window.partitionBy("bucket").orderBy(
            F.xxhash64("id", "bucket", F.lit(seed)), "id")
        return rows.withColumn("n", F.row_number().over(order)).where(
            F.col("n") <= number).drop("n")

    pairs = scratch.stage(meet(members, chosen(members, 1, 1),
                               FIRST_PARTNERS, []), "pairs")
    links = scratch.stage(test(pairs), "tested")
    found = connected_components(scratch, links)
    tested, extra = pairs, None
    for best, last in ((SECOND_PARTNERS, False), (None, True)):
        found = scratch.stage(found, "components")
        rows = _open(scratch, members, found, payload)
        if rows.isEmpty():
            break
        if last:
            small = rows.where(F.col("size") <= BLOCK)
            pairs = meet(small.where("comp <> main"), small, best, ["comp"])
            large = scratch.stage(rows.where(F.col("size") > BLOCK), "large")
            extra = None if large.isEmpty() else _block_links(
                scratch, large.join(evidence, "id"), near, linked)
        else:
            pairs = meet(rows.where("comp <> main"),
                         chosen(rows, 2, SECOND_PIVOTS), best, ["comp"])
        pairs = scratch.stage(pairs.join(tested, ["a", "b"], "left_anti"),
                              "pairs")
        links = test(pairs)
        links = scratch.stage(links if extra is None else links.union(extra),
                              "tested")
        if not links.isEmpty():
            found = connected_components(scratch, links.union(
                found.select("id", "comp").toDF("a", "b")))
        tested = tested.union(pairs)
    return found


def _open(scratch: Scratch, members: DataFrame, found: DataFrame,
          payload: list[str]) -> DataFrame:
    """Members of buckets with several components, and the largest one."""
    rows = members.join(found, "id", "left").withColumn(
        "comp", F.coalesce("comp", "id")).select(
        "bucket", "id", "comp", *payload)
    rows = scratch.stage(rows, "members")
    spans = rows.groupBy("bucket").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high")).where(
        "low <> high").select("bucket")
    rows = scratch.stage(rows.join(scratch.stage(spans, "open-buckets"),
                                   "bucket"), "open-members")
    counts = rows.groupBy("bucket", "comp").agg(
        F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("bucket").agg(
        F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("size")
    ).select("bucket", F.col("m.comp").alias("main"), "size")
    return rows.join(scratch.stage(main, "main-components"), "bucket")


def _block_links(scratch: Scratch, rows: DataFrame, near,
                 linked) -> DataFrame:
    """(a, b): links between outside members and members of their bucket.

    The members of a bucket are dealt into blocks by a hash; each pair of
    blocks is one row, inside which all members meet.
    """
    member = F.struct(*[c for c in rows.columns
                        if c not in ("bucket", "main", "size")])
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = scratch.stage(rows.select(
        "bucket", (F.col("comp") != F.col("main")).alias("out"),
        F.pmod(F.xxhash64("id"), blocks).alias("block"),
        member.alias("m")), "block-members")

    def gathered(chosen: DataFrame, name: str) -> DataFrame:
        return chosen.groupBy("bucket", "block").agg(
            F.collect_list("m").alias(name)).drop("block")

    def meeting(x: Column, y: Column) -> Column:
        condition, _ = near(lambda c: x[c], lambda c: y[c])
        return (x["comp"] != y["comp"]) & condition & linked(x, y)

    def partners(x: Column) -> Column:
        return F.transform(
            F.filter("all", lambda y: meeting(x, y)),
            lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))

    return gathered(dealt.where("out"), "some").join(
        gathered(dealt, "all"), "bucket").select(F.inline(F.flatten(
            F.transform("some", partners)))).distinct()

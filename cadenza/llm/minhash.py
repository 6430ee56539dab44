"""Near duplicates by fast similarity sketching, bands and exact tests.

A set of shingles is sketched in rounds: each round hashes every element to
a bin and a value, and a bin keeps its smallest value of its first round;
after as many rounds as bins, each further round fills one bin with all
elements, so that every coordinate fills.  Bands of coordinates make the
candidates; full sets decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.llm import linking
from cadenza.llm.common import Scratch, bounded, map_arrow


@dataclass(frozen=True)
class Settings:
    """Shingles of ``words`` words; links at ``percent`` of the union.

    With 48 bands of 7 coordinates a pair at 0.8 shares no band with a
    probability of 0.00001, a pair at 0.5 shares one with 0.31.
    """
    words: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 7
    #: Standard deviations that an estimate may fall below the threshold
    #: before a candidate is left untested.
    deviations: float = 5.5

    @property
    def bins(self) -> int:
        return self.bands * self.rows

    @property
    def most_different(self) -> int:
        """Most coordinates whose two-bit codes may differ in a link."""
        share = 0.75 * (1 - self.percent / 100)
        return int(self.bins * share + self.deviations * (
            self.bins * share * (1 - share)) ** 0.5)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words.

    A-Z are lower-cased; a word is a run without ASCII blanks.  Fewer words
    are one shingle, no word is none.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    size = min(words, len(found))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64,
                         len(found))
    count = len(found) - size + 1
    acc = np.full(count, size, np.uint64)
    for i in range(size):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + count])
    return np.unique(acc)


def sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """One value per bin: the round in the upper, a hash in the lower half."""
    empty = np.uint64(2 ** 64 - 1)
    out = np.full(bins, empty)
    done, size, low = 0, len(items), np.uint64(0xFFFFFFFF)
    while done < bins:
        # rounds are taken together as long as they stay cheap; a later
        # round never replaces the value of an earlier one
        rounds = np.arange(done, min(bins, done + max(1, 2 * bins // size)),
                           dtype=np.uint64)
        h = mix(items[None, :] + mix(rounds + np.uint64(1))[:, None])
        at = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        np.minimum.at(out, at.ravel().astype(np.intp),
                      ((rounds << np.uint64(32))[:, None]
                       | (h & low)).ravel())
        done += len(rounds)
        if not (out == empty).any():
            return out
    for b in np.flatnonzero(out == empty):
        turn = np.array([bins + int(b)], np.uint64)
        h = mix(items + mix(turn + np.uint64(1)))
        out[b] = (turn[0] << np.uint64(32)) | (h & low).min()
    return out


def bands(values: np.ndarray, number: int) -> np.ndarray:
    keys = np.arange(number, dtype=np.uint64)
    for column in values.reshape(number, -1).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def codes(values: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 in a word; the rest is zero."""
    two = mix(values + np.uint64(7)) & np.uint64(3)
    two = np.pad(two, (0, -len(two) % 32)).reshape(-1, 32)
    return (two << np.arange(0, 64, 2, dtype=np.uint64)).sum(
        1, dtype=np.uint64)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends),
                                    pa.array(flat.view(np.int64)))


def describe(docs: DataFrame, settings: Settings, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(row, doc_id, n_shingles, d1, d2, keys, code) for every row.

    d1 and d2 are a digest of the set; rows without a word have no keys.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col(doc_id).alias("doc_id"),
                       F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    none = np.empty(0, np.uint64)

    def work(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, settings.words)
                for t in batch.column(2).to_pylist()]
        drawn = [sketch(s, settings.bins) if len(s) else none for s in sets]
        digest = np.array([_digest(s) for s in sets], np.uint64).reshape(
            -1, 2).view(np.int64)
        return {"row": batch.column(0), "doc_id": batch.column(1),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "d1": pa.array(digest[:, 0]), "d2": pa.array(digest[:, 1]),
                "keys": _longs([bands(d, settings.bands) if len(d) else d
                                for d in drawn]),
                "code": _longs([codes(d) if len(d) else d for d in drawn])}
    return map_arrow(rows, f"row bigint, doc_id {kind}, n_shingles bigint, "
                     "d1 bigint, d2 bigint, keys array<bigint>, "
                     "code array<bigint>", work)


def _digest(items: np.ndarray) -> tuple[int, int]:
    return divmod(xxhash.xxh3_128_intdigest(items.tobytes()), 2 ** 64)


def full_sets(docs: DataFrame, settings: Settings,
              text: str = "text") -> DataFrame:
    """(d1, d2, items) for every row with a word."""
    def work(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, settings.words)
                for t in batch.column(0).to_pylist()]
        digest = np.array([_digest(s) for s in sets], np.uint64).reshape(
            -1, 2).view(np.int64)
        return {"d1": pa.array(digest[:, 0]), "d2": pa.array(digest[:, 1]),
                "items": _longs(sets)}
    return map_arrow(docs.select(text),
                     "d1 bigint, d2 bigint, items array<bigint>", work)


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(id, own): the shingles of a set that no other set holds."""
    held = sets.select("id", F.explode("items").alias("item")).groupBy(
        "item").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return held.where("n = 1").groupBy("id").agg(
        F.count(F.lit(1)).alias("own"))


def near_duplicates(scratch: Scratch, docs: DataFrame, settings: Settings,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Rows with equal sets are one class; classes are linked by sketches and
    confirmed on full sets.  ``component_id`` is the smallest doc_id that a
    row reaches, itself included; ``kept`` marks the rows that carry it.
    A row without a word (null, empty, blank) is its own component.  Rows
    that repeat a doc_id and a text are kept or dropped together; null ids
    are never the smallest unless a component has no other.  An empty table
    gives no row.  The result reads tables of ``scratch``.
    """
    rows = scratch.stage(describe(docs, settings, doc_id, text), "sketches")
    classes = rows.where("n_shingles > 0").groupBy(
        "d1", "d2", "n_shingles").agg(
        F.min("row").alias("id"), F.min("doc_id").alias("first_doc"),
        F.min("keys").alias("keys"), F.min("code").alias("code"))
    classes = scratch.stage(classes, "classes")
    members = linking.shared_buckets(scratch, classes.select(
        F.explode("keys").alias("bucket"), "id")).join(
        classes.select("id", "n_shingles", "code"), "id").select(
        "bucket", "id", "n_shingles", "code")
    members = scratch.stage(members, "members")
    wanted = members.select("id").distinct().join(
        classes.select("id", "d1", "d2", "first_doc"), "id")
    wanted = scratch.stage(wanted, "wanted")
    # texts of the wanted classes, by the smallest doc_id of each; what else
    # carries that id falls out by its digest
    read = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    ids = scratch.stage(wanted.select(F.col("first_doc").alias("_wanted"))
                        .distinct(), "wanted-ids")
    texts = read.join(bounded(ids), read["_id"].eqNullSafe(
        F.col("_wanted")), "left_semi")
    sets = scratch.stage(
        full_sets(texts, settings).join(
            bounded(wanted).select("id", "d1", "d2"), ["d1", "d2"])
        .dropDuplicates(["id"]).select("id", "items"), "sets")
    members = scratch.stage(members.join(
        bounded(scratch.stage(_own_shingles(sets), "own")), "id", "left")
        .withColumn("shared", F.col("n_shingles") - F.coalesce(
            "own", F.lit(0))).drop("own"), "members")

    def test(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(sets.select(F.col("id").alias("a"),
                                       F.col("items").alias("s")), "a")
                .join(sets.select(F.col("id").alias("b"),
                                  F.col("items").alias("t")), "b"))
        common = F.size(F.array_intersect("s", "t"))
        union = F.size("s") + F.size("t") - common
        return both.where(common * 100 >= union * settings.percent).select(
            "a", "b")

    def near(a, b) -> tuple[Column, Column]:
        far = F.lit(0)
        for i in range(-(-settings.bins // 32)):
            x = a("code")[i].bitwiseXOR(b("code")[i])
            far = far + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1))
                                    .bitwiseAND(F.lit(0x5555555555555555)))
        # an upper bound of the intersection: what others hold too
        common = F.least(a("shared"), b("shared"))
        union = a("n_shingles") + b("n_shingles") - common
        return ((common * 100 >= union * settings.percent)
                & (far <= settings.most_different)), far

    def linked(x: Column, y: Column) -> Column:
        common = F.size(F.array_intersect(x["items"], y["items"]))
        union = F.size(x["items"]) + F.size(y["items"]) - common
        return common * 100 >= union * settings.percent

    found = linking.components(scratch, members, near, test, sets, linked)
    labelled = classes.select("id", "d1", "d2", "n_shingles",
                              "first_doc").join(found, "id", "left")
    labelled = labelled.withColumn("comp", F.coalesce("comp", "id"))
    smallest = labelled.groupBy("comp").agg(
        F.min("first_doc").alias("component_id"))
    labelled = scratch.stage(labelled.join(smallest, "comp").select(
        "d1", "d2", "n_shingles", "component_id", F.lit(1).alias("has")),
        "components")
    return (rows.select("doc_id", "n_shingles", "d1", "d2")
            .join(labelled, ["d1", "d2", "n_shingles"], "left")
            .withColumn("component_id", F.when(
                F.col("has").isNull(), F.col("doc_id"))
                .otherwise(F.col("component_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id"))
                    .alias("kept")))


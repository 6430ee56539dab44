"""Whitening of embeddings by the largest components of their covariance.

Sums and the covariance over the distinct vectors are added up in the tasks
that read them; what leaves a task has the size of the dimensions, not of
the rows.  The components come from contour integrals (``contour``), and a
last pass projects every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadenza.llm import contour
from cadenza.llm.common import Scratch
from cadenza.llm.vectors import (common_length, integer_vectors, lists,
                                 matrix)

SCALE, COMPONENTS = 256, 4


@dataclass(frozen=True)
class Whitening:
    """What the fit list says: its size, sums per dimension, the trace of
    the covariance, eigenvalues (falling) and eigenvectors (rows)."""
    count: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.count for s in self.sums])

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (
            self.vectors / np.sqrt(self.values)[:, None]).T


def second_moments(rows: DataFrame, x: str, width: int, centred) -> np.ndarray:
    """Sum over the rows of the outer product of ``centred(x)`` with itself.

    Each task adds up one matrix and the matrices are added by their rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                c = centred(matrix(batch.column(0), width).astype(float))
                total = c.T @ c + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total))), lists(total)],
                ["i", "line"])
    parts = rows.select(x).mapInArrow(run, "i bigint, line array<double>")
    added = parts.select("i", F.posexplode("line").alias("j", "v")).groupBy(
        "i", "j").agg(F.sum("v").alias("v")).collect()  # dimensions squared
    size = 1 + max((r["i"] for r in added), default=-1)
    out = np.zeros((size, size))
    for r in added:
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def fit(scratch: Scratch, rows: DataFrame, x: str,
        components: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """The whitening of the distinct vectors ``x`` of ``rows``, and these."""
    each = scratch.stage(rows.select(F.col(x).alias("x")).distinct(),
                         "fit-list")
    count = each.count()
    sums = [int(r["s"]) for r in each.select(F.posexplode("x").alias(
        "i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)"))
                                    .alias("s")).orderBy("i").collect()]
    mean = np.array([s / count for s in sums])
    v = second_moments(each, "x", len(sums), lambda c: c - mean) / max(
        count, 1) if sums else np.zeros((0, 0))
    values, vectors = contour.largest(v, components)
    return Whitening(count, tuple(sums), float(np.trace(v)), values,
                     vectors), each


def whiten(scratch: Scratch, rows: DataFrame, vec_id: str = "vec_id",
           vector: str = "embedding", scale: int = SCALE,
           components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained,
    identity_error) for every row and component.

    Rows whose vector is null or holds a null or non-finite entry, or is not
    of the most frequent length, take no part.  Entries become
    floor(scale * c); equal vectors count once in the fit and all of them
    are returned, as are rows that repeat an id and rows of a null id.
    ``deviation`` is the exact sum of (n x - S)^2 as a decimal.  Components
    of no variance are left out, so that one distinct vector alone, or an
    empty table, gives no row.  Other columns are not looked at.
    """
    kept = integer_vectors(rows, vector, "x", scale,
                           {"vec_id": F.col(vec_id)})
    width = common_length(kept, "x")
    kept = kept.where(F.size("x") == width)
    kind = kept.schema["vec_id"].dataType.simpleString()
    model, each = fit(scratch, kept, "x", components)
    found = len(model.values)
    error = float(np.abs(second_moments(
        each, "x", width, model.project) / model.count
        - np.eye(found)).max()) if found else 0.0
    n, sums = model.count, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(sums, dtype=object)
        squares, small = int((s * s).sum()), all(
            abs(v) < 1 << 31 for v in sums)
        for batch in batches:
            if not batch.num_rows or not found:
                continue
            x = matrix(batch.column(1), width)
            if small and np.abs(x).max() < 1 << 20:
                own = (x * x).sum(axis=1)
                cross = x @ np.array(sums, np.int64)
            else:  # Python's integers
                big = x.astype(object)
                own, cross = (big * big).sum(axis=1), big @ s
            # sum of (n x - S)^2, term by term
            spread = [n * n * int(a) - 2 * n * int(b) + squares
                      for a, b in zip(own, cross)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array(spread, pa.decimal128(38, 0)),
                 lists(model.project(x.astype(float)))],
                ["vec_id", "deviation", "w"])
    projected = kept.select("vec_id", "x").mapInArrow(
        run, f"vec_id {kind}, deviation decimal(38,0), w array<double>")
    explained = F.array(*[F.lit(e) for e in model.explained]) if found \
        else F.array().cast("array<double>")
    return projected.select(
        "vec_id", "deviation", F.posexplode("w").alias("at", "whitened")
    ).select("vec_id", (F.col("at") + 1).alias("component"),
             F.lit(n).cast("long").alias("n"), "deviation", "whitened",
             F.get(explained, F.col("at")).alias("explained"),
             F.lit(error).alias("identity_error"))

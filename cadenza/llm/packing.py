"""Concatenate and cut: pack tokens of all documents into full sequences.

The first pass tokenises each document once and writes ids with the tokens
that precede it in its partition.  A prefix sum over the partitions' totals
then gives each document its place in one endless row of tokens, which is
cut every ``length`` tokens; a piece is what one window holds of a document.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.llm.common import Scratch, pieces

SEQUENCE_LENGTH = 2048
END_OF_TEXT = 1


def byte_bpe(path: str, pattern: str):
    """The byte-level vocabulary of a rank file as ``text -> ids``, which
    knows no special strings."""
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in
                 (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                             special_tokens={}).encode_ordinary


#: Strings of ``byte_bpe_50k.json`` that are tokens of their own.
ADDED = ("<|endoftext|>",)


def public_byte_bpe():
    """The ids of ``byte_bpe_50k.json`` as ``text -> ids``.

    Its rank file gives them several times as fast for texts without an
    added token's string; the others go to the JSON file itself.
    """
    import public_tokenizers
    from tokenizers import Tokenizer
    ranks = byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"),
                     public_tokenizers.PATTERN)
    whole = []

    def encode(text: str) -> list[int]:
        if not any(a in text for a in ADDED):
            return ranks(text)
        if not whole:
            whole.append(Tokenizer.from_file(
                public_tokenizers.path("byte_bpe_50k.json")))
        return whole[0].encode(text, add_special_tokens=False).ids
    return encode


def tokenize(docs: DataFrame, load=public_byte_bpe, doc_id: str = "doc_id",
             text: str = "text", end: int = END_OF_TEXT) -> DataFrame:
    """(doc_id, part, before, n_tokens, ids) for every row.

    ``ids`` are little-endian unsigned 32-bit numbers closed by ``end``;
    a null or empty text is ``end`` alone.  ``before`` counts the tokens that
    precede the row in its partition ``part``.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.spark_partition_id().alias("part"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode, before = load(), 0
        for batch in batches:
            for piece in pieces(batch):
                ids = [encode(t) if t else [] for t in
                       piece.column(1).to_pylist()]
                counts = np.array([len(i) + 1 for i in ids], np.int64)
                ends = before + counts.cumsum()
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2),
                     pa.array(ends - counts), pa.array(counts),
                     pa.array([np.array([*i, end], "<u4").tobytes()
                               for i in ids], pa.binary())],
                    ["doc_id", "part", "before", "n_tokens", "ids"])
                before = int(ends[-1])
    return rows.mapInArrow(run, f"doc_id {kind}, part int, before bigint, "
                                "n_tokens bigint, ids binary")


def pack(scratch: Scratch, docs: DataFrame, load=public_byte_bpe,
         doc_id: str = "doc_id", text: str = "text",
         length: int = SEQUENCE_LENGTH) -> DataFrame:
    """One row per piece of a document, with its tokens.

    Columns: doc_id, start (the document's tokens before the piece), length,
    ids (little-endian unsigned 32-bit numbers), doc_tokens (with the end
    mark), sequence_id, offset (place in the sequence).  Every sequence but
    the last is full, so that only the last is padded.  Each row of ``docs``
    is a document, repeated ids and null ids included; a null or empty text
    is its end mark alone; an empty table gives no piece.
    """
    placed = scratch.keep(tokenize(docs, load, doc_id, text), "tokens")
    # one row per partition; its size is that of the list of tasks
    totals = scratch.keep(placed.groupBy("part").agg(
        F.sum("n_tokens").alias("n")), "token-totals")
    earlier = Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(
        F.sum("n").over(earlier), F.lit(0)).alias("base"))
    at = F.col("base") + F.col("before")
    first = F.floor(F.col("at") / length)
    last = F.floor((F.col("at") + F.col("n_tokens") - 1) / length)

    def piece(window: Column) -> Column:
        start = F.greatest(window * length - F.col("at"), F.lit(0))
        stop = F.least((window + 1) * length - F.col("at"),
                       F.col("n_tokens"))
        return F.struct(
            start.cast("long").alias("start"),
            (stop - start).cast("long").alias("length"),
            F.substring(F.col("ids"), (start * 4 + 1).cast("int"),
                        ((stop - start) * 4).cast("int")).alias("ids"),
            window.cast("long").alias("sequence_id"),
            (F.col("at") + start - window * length).cast("long")
            .alias("offset"))
    return (placed.join(F.broadcast(bases), "part").withColumn("at", at)
            .select("doc_id", F.col("n_tokens").alias("doc_tokens"),
                    F.explode(F.transform(F.sequence(first, last), piece))
                    .alias("p"))
            .select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens",
                    "p.sequence_id", "p.offset"))

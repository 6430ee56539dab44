"""Best-fit packing by minimum bin slack.

A bin starts with the longest length left; a subset-sum over the other
lengths left, kept as the bits of one integer, finds the fullest feasible
combination, which is then taken out.  Lengths are at most the capacity, so
the whole choice works on a histogram of as many rows, and a combination is
taken out as often as its lengths last.  The pieces, numbered within their
length by prefix sums, are then dealt to the bins.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cadenza.llm.common import Scratch, bounded, pieces

SEQUENCE_LENGTH = 4096
END_OF_TEXT = 1
#: Different words whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 1_000_000, 64
#: Marks that end words; after a letter or digit a run of them stands alone.
MARKS = b".,;:!?#$%&*"
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


def public_word_bpe() -> Callable[[list[str]], list[bytes]]:
    """texts -> ids as little-endian unsigned 32-bit numbers.

    The vocabulary drops white space, joins nothing across it and lower-
    cases, so that a text's ids are those of its words.  A worker process
    remembers them from task to task.
    """
    store = sys.modules.setdefault(
        "word_ids_of_this_worker", ModuleType("word_ids_of_this_worker"))
    if not hasattr(store, "encode"):
        store.encode = _word_encoder()
    return store.encode


def _word_encoder() -> Callable[[list[str]], list[bytes]]:
    import public_tokenizers
    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    known: dict[bytes, bytes] = {}

    merge = own.model.tokenize

    def ask(words: set[bytes]) -> None:
        # nothing is normalised in words of these letters, nor are they cut
        plain = {w for w in words if w.isalpha() and w.islower()}
        for word in plain:
            known[word] = np.array([x.id for x in merge(word.decode())],
                                   "<u4").tobytes()
        rest = list(words - plain)
        for word, e in zip(rest, own.encode_batch_fast(
                [w.decode() for w in rest], add_special_tokens=False)):
            known[word] = np.array(e.ids, "<u4").tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        # a special token's string is one in its own case only
        raw = [t.encode() for t in texts]
        split = [(t if b"<|" in t else t.lower()).split() for t in raw]
        if len(known) > REMEMBERED:
            known.clear()
        new = set().union(*split).difference(known)
        ends = {}
        for word in new:
            head = word.rstrip(MARKS)
            if head != word and head and head[-1] in _LETTERS:
                ends[word] = head, word[len(head):]
        ask(new.difference(ends).union(*ends.values()).difference(known))
        for word, (head, marks) in ends.items():
            known[word] = known[head] + known[marks]
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for word in [w for w in new if len(w) > LONGEST]:
            del known[word]
        return out
    return encode


def cut(docs: DataFrame, load=public_word_bpe, doc_id: str = "doc_id",
        text: str = "text", length: int = SEQUENCE_LENGTH,
        end: int = END_OF_TEXT) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, nth) for every piece.

    ``nth`` counts the pieces of that length before it in partition
    ``part``.  A document's ids end with ``end``; a null or empty text is
    ``end`` alone.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"),
                       F.col(text).alias("text"),
                       F.spark_partition_id().alias("part"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = load(), np.zeros(length + 1, np.int64)
        for batch in batches:
            for some in pieces(batch):
                ids = encode([t or "" for t in some.column(1).to_pylist()])
                at, piece, out, nth = [], [], [], []
                for row, own in enumerate(ids):
                    own += last
                    for n, start in enumerate(range(0, len(own),
                                                    4 * length)):
                        out.append(own[start:start + 4 * length])
                        at.append(row)
                        piece.append(n)
                        size = len(out[-1]) // 4
                        nth.append(seen[size])
                        seen[size] += 1
                piece = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(at, pa.int64())),
                     pa.array(piece),
                     pa.array(piece.astype(np.int64) * length),
                     pa.array([len(o) // 4 for o in out], pa.int64()),
                     pa.array(out, pa.binary()),
                     some.column(2).take(pa.array(at, pa.int64())),
                     pa.array(nth, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids", "part",
                     "nth"])
    return rows.mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, "
             "ids binary, part int, nth bigint")


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """The lengths, with how often, that fill ``room`` as far as can be.

    ``left`` has the lengths that are left, falling.  Bit s of the integer
    is set if a sum of s can be reached; lengths join one after another, the
    longest first, until the room can be filled or none is left.
    """
    reach, steps, full = 1, [], 1 << room
    mask = (full << 1) - 1
    for length, count in left.items():
        if reach & full:
            break
        if length > room:
            continue
        before, most, step = reach, min(count, room // length), 1
        steps.append((length, most, before))
        while most > 0:  # 1, 2, 4 .. and the rest give every number
            step = min(step, most)
            reach |= (reach << step * length) & mask
            most -= step
            step *= 2
    total, chosen = reach.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        for times in range(most + 1):
            if before >> (total - times * length) & 1:
                break
        if times:
            chosen[length] = times
            total -= times * length
    return chosen


def combinations(histogram: dict[int, int],
                 capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(bins, {length: pieces of it in such a bin}) that use up all."""
    left = dict(sorted(histogram.items(), reverse=True))
    left = {length: n for length, n in left.items() if n}
    out = []
    while left:
        longest = next(iter(left))
        left[longest] -= 1
        bin_ = fullest(left, capacity - longest)
        left[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(left[length] // n for length, n in bin_.items())
        out.append((times, bin_))
        for length, n in bin_.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return out


def places(chosen: list[tuple[int, dict[int, int]]]):
    """For each length the runs of its pieces: arrays (first piece, first
    bin, pieces of it in a bin, offset of the first)."""
    runs: dict[int, list] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for times, bin_ in chosen:
        offset = 0
        for length in sorted(bin_, reverse=True):
            n = bin_[length]
            runs.setdefault(length, []).append(
                (used.get(length, 0), first_bin, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first_bin += times
    return {length: np.array(r, np.int64).T for length, r in runs.items()}


def pack(scratch: Scratch, docs: DataFrame, load=public_word_bpe,
         doc_id: str = "doc_id", text: str = "text",
         length: int = SEQUENCE_LENGTH) -> DataFrame:
    """One row per piece of a document, with its tokens.

    Columns: doc_id, piece (from 0), start (the document's tokens before
    it), length, ids (little-endian unsigned 32-bit numbers), sequence_id
    (gapless from 0) and offset (place in the sequence).  Documents of more
    than ``length`` tokens are cut into pieces of that many, the last may be
    shorter; no other is cut.  Each row of ``docs`` is a document, repeated
    ids and null ids included; a null or empty text is its end mark alone;
    an empty table gives no piece.  Other columns are not looked at.
    """
    cuts = scratch.keep(cut(docs, load, doc_id, text, length), "pieces")
    # at most ``length`` rows for each task that read documents
    counts = scratch.stage(cuts.groupBy("length", "part").agg(
        F.count(F.lit(1)).alias("n")), "piece-counts")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = scratch.keep(counts.select(
        "length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0))
        .alias("base")), "piece-bases")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(
        F.sum("n").alias("n")).collect()}  # at most ``length`` rows
    runs = places(combinations(histogram, length))
    numbered = cuts.join(bounded(bases), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids",
        (F.col("base") + F.col("nth")).alias("number"))
    kind = numbered.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(3).to_numpy()
            number = batch.column(5).to_numpy()
            sequence = np.empty(len(size), np.int64)
            offset = np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            ends = np.flatnonzero(np.diff(size[order])) + 1
            for rows in np.split(order, ends):
                if not len(rows):
                    continue
                own = int(size[rows[0]])
                first, first_bin, each, start = runs[own]
                at = np.searchsorted(first, number[rows], "right") - 1
                nth = number[rows] - first[at]
                sequence[rows] = first_bin[at] + nth // each[at]
                offset[rows] = start[at] + nth % each[at] * own
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(5)], pa.array(sequence),
                 pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids", "sequence_id",
                 "offset"])
    return numbered.mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, "
             "ids binary, sequence_id bigint, offset bigint")

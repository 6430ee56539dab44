"""Benchmark decontamination: rare n-gram seeds and local alignment.

The n-grams of the test items are a table, counted in the corpus.  Of each
two adjacent n-grams of an item the rarer one is a seed, whatever its count,
so that the choice is relative to the item and no part of it stays without
one.  Seeds join texts to items, and where they meet, text and item are
aligned (Smith-Waterman over words), so that edited copies score too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from cadenza.llm.common import Scratch, bounded, map_arrow
from cadenza.llm.minhash import mix

#: What separates words beside everything in ASCII but letters and digits:
#: Latin-1 signs, general and CJK punctuation, arrows to symbols, full-width
#: marks.
MARKS = re.compile("[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\u2000-\u206f"
                   "\u2190-\u2bff\u3000-\u3004\u3007-\u3020\uff01-\uff0f"
                   "\uff1a-\uff20]+")
#: Characters of writing systems without blanks; each is a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff"
                      "\u3400-\u9fff\uf900-\ufaff]")
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Bits of the filter for n-grams: so many for each, and at most 16 MB.
FILTER_BITS, MOST_BITS = 16, 1 << 27
#: The copies of an item tip the counts of its n-grams a little; counts so
#: close count as equal.
CLOSE = 2
#: Cells of an alignment table held at once, windows side by side.
CELLS = 1 << 21


@dataclass(frozen=True)
class Settings:
    """``ngram`` words make a seed.

    ``match``, ``mismatch`` and ``gap`` score the alignment; a text is
    contaminated if the score reaches ``share`` of that of the whole item.
    An item of fewer than ``short`` words must occur whole: parts of it are
    anybody's words.
    """
    ngram: int = 3
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    share: float = 0.5
    short: int = 8


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits, lower case, as UTF-8."""
    plain = (text or "").lower()
    if not plain.isascii():
        plain = UNSPACED.sub(r" \g<0> ", MARKS.sub(" ", plain))
    return plain.encode("utf-8", "replace").translate(_PLAIN).split()


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64,
                       len(found))


def ngrams(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words."""
    if len(codes) < size:
        return np.empty(0, np.uint64)
    count = len(codes) - size + 1
    acc = np.full(count, size, np.uint64)
    for i in range(size):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + count])
    return acc


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends),
                                    pa.array(flat.view(np.int64)))


def load_items(benchmark: DataFrame, settings: Settings,
               item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, size, codes, grams) of every item with a word.

    An item shorter than a seed has one n-gram, of its own length.
    """
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"),
                            F.col(item_id).alias("item_id"),
                            F.col(text).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        codes = [hashes(words(t)) for t in batch.column(2).to_pylist()]
        sizes = [min(settings.ngram, len(c)) for c in codes]
        return {"item": batch.column(0), "item_id": batch.column(1),
                "size": pa.array(sizes, pa.int32()), "codes": _longs(codes),
                "grams": _longs([ngrams(c, n) if n else c
                                 for c, n in zip(codes, sizes)])}
    return map_arrow(rows, f"item bigint, item_id {kind}, size int, "
                     "codes array<bigint>, grams array<bigint>", work
                     ).where("size > 0")


def gram_filter(items: DataFrame) -> np.ndarray:
    """Bits that are set for the n-grams of the items, and maybe for others.

    Of bounded size, whatever the benchmark: it only thins out what the join
    by n-gram would drop.
    """
    count = items.agg(F.sum(F.size("grams"))).first()[0] or 0
    bits = 1 << min(MOST_BITS.bit_length() - 1,
                    max(10, (count * FILTER_BITS).bit_length()))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            grams = batch.column(0).flatten().to_numpy().view(np.uint64)
            own[grams & np.uint64(bits - 1)] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array([np.packbits(own).tobytes()])], ["bits"])
    packed = np.zeros(bits // 8, np.uint8)
    # a bitmap of each task that reads items, one after the other
    for row in items.select("grams").coalesce(8).mapInArrow(
            parts, "bits binary").toLocalIterator():
        packed |= np.frombuffer(row["bits"], np.uint8)
    return packed


def find_grams(docs: DataFrame, packed: np.ndarray, sizes: list[int]
               ) -> DataFrame:
    """(doc_id, version, gram, places) of n-grams that pass the filter."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    mask = np.uint64(len(packed) * 8 - 1)

    def setup():
        known = np.unpackbits(packed).view(bool)

        def work(batch: pa.RecordBatch) -> dict:
            rows, grams, places = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                codes = hashes(words(text))
                for size in sizes:
                    own = ngrams(codes, size)
                    at = np.flatnonzero(known[own & mask])
                    if not len(at):
                        continue
                    order = np.argsort(own[at], kind="stable")
                    at, own = at[order], own[at][order]
                    first = np.flatnonzero(np.diff(own, prepend=~own[:1]))
                    rows += [row] * len(first)
                    grams.append(own[first])
                    places += np.split(at, first[1:])
            which = pa.array(rows, pa.int64())
            return {"doc_id": batch.column(0).take(which),
                    "version": batch.column(1).take(which),
                    "gram": pa.array((np.concatenate(grams) if grams else
                                      np.empty(0, np.uint64)).view(np.int64)),
                    "places": _longs([p.astype(np.int64) for p in places])}
        return work
    return map_arrow(
        docs, f"doc_id {kind}, version bigint, gram bigint, "
        "places array<bigint>", None, setup)


def choose_seeds(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, item, position): n-grams no more than CLOSE times as frequent
    as a neighbour, and so of each two adjacent ones the rarer at least.

    An n-gram that no text holds has a count of zero and finds nothing; then
    its neighbour is a seed as well, so that a copy that lacks it is found.
    """
    placed = items.select("item", F.posexplode("grams").alias(
        "position", "gram")).join(counts, "gram", "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))
    run = Window.partitionBy("item").orderBy("position")
    before, after = F.lag("n").over(run), F.lead("n").over(run)
    rarer = [F.coalesce((F.col("n") <= beside * CLOSE) | (beside == 0),
                        F.lit(False)) for beside in (before, after)]
    alone = before.isNull() & after.isNull()
    return placed.withColumn("seed", rarer[0] | rarer[1] | alone).where(
        "seed AND n > 0").select("gram", "item", "position")


def align(item: np.ndarray, windows: list[np.ndarray],
          settings: Settings) -> list[tuple[int, int]]:
    """Best local score and its end (exclusive) in each window.

    Windows are aligned side by side, one row of the table per item word;
    gaps along the window are a running maximum.
    """
    width = max(map(len, windows))
    grid = np.zeros((len(windows), width), np.uint64)
    inside = np.zeros((len(windows), width), bool)
    for i, w in enumerate(windows):
        grid[i, :len(w)] = w
        inside[i, :len(w)] = True
    steps = np.arange(width, dtype=np.int32) * -settings.gap
    last = np.zeros((len(windows), width + 1), np.int32)
    best = np.zeros(len(windows), np.int32)
    ends = np.zeros(len(windows), np.int64)
    for code in item:
        score = np.where((grid == code) & inside, settings.match,
                         settings.mismatch).astype(np.int32)
        row = np.maximum(last[:, :-1] + score, last[:, 1:] + settings.gap)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row + steps, axis=1) - steps
        at = row.argmax(1)
        top = row[np.arange(len(row)), at]
        better = top > best
        best[better], ends[better] = top[better], at[better] + 1
        last[:, 1:] = row
    return list(zip(best.tolist(), ends.tolist()))


def _windows(starts: np.ndarray, length: int, item: int) -> list:
    """Merge the item-sized surroundings of starts into disjoint windows."""
    found = []
    for p in np.unique(starts).tolist():
        low, high = max(0, p - item // 2), min(length, p + item + item // 2)
        if found and low <= found[-1][1]:
            found[-1][1] = max(found[-1][1], high)
        else:
            found.append([low, high])
    return found


def _cut(low: int, high: int, item: int, settings: Settings) -> list:
    """Pieces of a window that hold every alignment worth anything.

    What is aligned with an item of n words has at most n matches and, to
    score above zero, fewer words without one than the matches pay for.
    """
    span = item + item * settings.match // max(1, -settings.gap)
    most = max(2 * span, CELLS // 8)
    if high - low <= most:
        return [(low, high)]
    return [(at, min(at + most, high))
            for at in range(low, max(low + 1, high - span), most - span)]


def _least(size: int, settings: Settings) -> float:
    """The share of a full match that an item asks for."""
    return settings.share if size >= settings.short else 1.0


def best_alignments(pairs: list[tuple], settings: Settings) -> list:
    """(pair, share, end) of the pairs (codes of a text, codes of an item,
    starts) that reach the share; tables of one item stand side by side."""
    by_item: dict[bytes, list] = {}
    for number, (codes, item, starts) in enumerate(pairs):
        vocabulary = np.unique(item)
        for low, high in _windows(starts, len(codes), len(item)):
            # each word scores one match at most
            common = int(np.isin(codes[low:high], vocabulary).sum())
            if common / len(item) >= _least(len(item), settings):
                by_item.setdefault(item.tobytes(), []).extend(
                    (number, a, codes[a:b])
                    for a, b in _cut(low, high, len(item), settings))
    best: dict[int, tuple[float, int]] = {}
    for key, tasks in by_item.items():
        item = np.frombuffer(key, np.uint64)
        full = settings.match * len(item)
        tasks.sort(key=lambda task: (len(task[2]), task[0], task[1]))
        while tasks:
            side = max(1, CELLS // max(1, len(tasks[-1][2])))
            part, tasks = tasks[-side:], tasks[:-side]
            for (number, low, _), (score, end) in zip(part, align(
                    item, [w for _, _, w in part], settings)):
                share, at = score / full, low + end
                if share >= _least(len(item), settings):
                    old = best.get(number, (0.0, 0))
                    if (share, -at) > (old[0], -old[1]):
                        best[number] = (share, at)
    return [(number, *found) for number, found in sorted(best.items())]


def score(pairs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, item, score, end_word) of texts with their ``met`` items."""
    kind = pairs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        listed, owners = [], []
        for row, (text, met) in enumerate(zip(
                batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            codes = hashes(words(text))
            for one in met:
                owners.append((row, one["item"]))
                listed.append((
                    codes, np.array(one["codes"], np.int64).view(np.uint64),
                    np.array(one["starts"], np.int64)))
        made = best_alignments(listed, settings)
        return {"doc_id": batch.column(0).take(pa.array(
                    [owners[m[0]][0] for m in made], pa.int64())),
                "item": pa.array([owners[m[0]][1] for m in made], pa.int64()),
                "score": pa.array([m[1] for m in made], pa.float64()),
                "end_word": pa.array([m[2] for m in made], pa.int64())}
    return map_arrow(pairs.select("doc_id", "text", "met"),
                     f"doc_id {kind}, item bigint, score double, "
                     "end_word bigint", work)


def contaminated(scratch: Scratch, docs: DataFrame, benchmark: DataFrame,
                 settings: Settings = Settings(), doc_id: str = "doc_id",
                 text: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, end_word) for every contaminated row.

    One row per row of ``docs`` and test item whose best local alignment
    around a seed reaches the share of a full match; ``end_word`` is the
    word of the text behind the first such alignment.  Null or empty texts
    and items match nothing; repeated rows are reported each; items with
    equal words are reported each; an empty benchmark or table gives no row.
    Other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"),
                       F.xxhash64(text).alias("version"),
                       F.col(text).alias("text"))
    items = scratch.stage(load_items(benchmark, settings, item_id, item_text),
                          "items")
    sizes = sorted(r["size"] for r in
                   items.select("size").distinct().collect())
    hits = scratch.stage(find_grams(rows, gram_filter(items), sizes), "grams")
    known = items.select(F.explode("grams").alias("gram")).distinct()
    hits = scratch.stage(hits.join(bounded(scratch.stage(known, "known")),
                                   "gram"), "hits")
    counts = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    seeds = scratch.stage(choose_seeds(items, counts), "seeds")
    starts = F.transform("places", lambda p: F.greatest(
        p - F.col("position"), F.lit(0).cast("long")))
    met = hits.join(bounded(seeds), "gram").groupBy(
        "doc_id", "version", "item").agg(F.array_distinct(F.flatten(
            F.collect_set(starts))).alias("starts"))
    met = met.join(items.select("item", "codes"), "item").groupBy(
        "doc_id", "version").agg(F.collect_list(F.struct(
            "item", "codes", "starts")).alias("met"))
    met = scratch.keep(met, "met").withColumnsRenamed(
        {"doc_id": "own_id", "version": "own_version"})
    pairs = rows.join(bounded(met), F.col("doc_id").eqNullSafe(
        F.col("own_id")) & (F.col("version") == F.col("own_version")))
    names = scratch.keep(items.select("item", "item_id"), "item-names")
    return score(pairs, settings).join(bounded(names), "item").select(
        "doc_id", "item_id", "score", "end_word")

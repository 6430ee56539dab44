"""Quality rules from tokeniser fertility.

Public vocabularies measure how well a text fits them: characters per token,
the share of byte-fallback tokens, and the entropy of the tokens.  A text
outside the band of its language (or script) and length class is rejected;
small classes take the band of another class, or a fixed one.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cadenza.llm.common import Scratch, map_arrow
from cadenza.llm.packing import public_byte_bpe

#: A band reaches so many quartile distances beyond the quartiles.
FENCE = 3.0
#: The least reach beyond the quartiles: 0.1 characters a token, one token of
#: ten, a quarter bit.  A class of copies, or without a fallback token, has
#: quartiles without a distance.
LEAST_REACH = {"chars_per_token": 0.1, "byte_share": 0.1,
               "token_entropy": 0.25}
#: Bands need so many documents; a smaller class takes another's band.
MIN_DOCUMENTS = 50
#: Bands where no class of the language or script has so many.
FIXED_BANDS = {"chars_per_token": (0.2, 12.0), "byte_share": (0.0, 0.5),
               "token_entropy": (2.0, 20.0)}
#: Base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
MEASURES = ("chars_per_token", "byte_share", "token_entropy")

#: First code point of letter ranges and the script they belong to.
_RANGES = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"),
           (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"),
           (0x700, "other"), (0x900, "devanagari"), (0x980, "other"),
           (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"),
           (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
           (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
           (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
           (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
           (0x20000, "han"), (0x30000, "other")]
_STARTS = np.array([start for start, _ in _RANGES])


def script(text: str | None) -> str:
    """The script of most letters; ``none`` without a letter."""
    letters = "".join(filter(str.isalpha, text or ""))
    if not letters:
        return "none"
    points = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"),
                           "<u4")
    counts = Counter()
    found = np.searchsorted(_STARTS, points, "right") - 1
    for at, n in zip(*np.unique(found, return_counts=True)):
        counts[_RANGES[max(at, 0)][1]] += int(n)
    return min(counts, key=lambda name: (-counts[name], name))


def repeat_words(ids: np.ndarray) -> int:
    """Words inside a window of three that occurs twice or more."""
    if len(ids) < 4:
        return 0
    _, inverse = np.unique(ids, return_inverse=True)
    base = int(inverse.max()) + 1
    pairs = inverse[:-1].astype(np.int64) * base + inverse[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    keys = pairs[:-1].astype(np.int64) * base + inverse[2:]
    _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    inside = np.zeros(len(ids), bool)
    for shift in range(3):
        inside[shift:shift + len(twice)] |= twice
    return int(inside.sum())


def duplicate_lines(content: bytes) -> int:
    lines = Counter(line for line in content.split(b"\n") if line.strip())
    return sum(lines.values()) - len(lines)


@dataclass(frozen=True)
class Vocabularies:
    """Loaders of the vocabularies; both are public files.

    ``pieces`` gives a sentencepiece processor with byte fallback, which
    measures fallback and entropy; ``encode`` a byte-level vocabulary, which
    measures characters per token.
    """
    piece_path: str | None = None
    encoder: object = public_byte_bpe

    def pieces(self):
        import sentencepiece
        path = self.piece_path
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("piece_bpe_32k.model")
        return sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self):
        return self.encoder()


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            lang: str | None = "lang",
            vocabularies: Vocabularies = Vocabularies()) -> DataFrame:
    """Base counts and fertility of every row.

    Words are runs without ASCII blanks.  Each different word of a batch is
    tokenised once, with a blank before it for the byte-level vocabulary.
    """
    key = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"),
                       F.col(text).alias("text"), key.alias("lang"),
                       F.xxhash64(text).alias("version"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def setup():
        pieces, encode = vocabularies.pieces(), vocabularies.encode()
        is_byte = np.array([pieces.is_byte(i)
                            for i in range(pieces.get_piece_size())])

        def work(batch: pa.RecordBatch) -> dict:
            texts = batch.column(1).to_pylist()
            contents = [(t or "").encode("utf-8", "replace") for t in texts]
            index: dict[bytes, int] = {}
            ids = [np.array([index.setdefault(w, len(index))
                             for w in content.split()], np.int64)
                   for content in contents]
            words = [w.decode() for w in index]
            sizes = np.array([len(encode(" " + w)) for w in words], np.int64)
            found = pieces.encode(words, num_threads=1) if words else []
            counts = np.array([len(f) for f in found], np.int64)
            flat = np.fromiter((i for f in found for i in f), np.int64)
            starts = counts.cumsum() - counts
            rows = [_row(texts[i], contents[i], ids[i], sizes, counts,
                         starts, flat, is_byte) for i in range(len(texts))]
            scripts = [script(t) for t in texts]
            made = {"doc_id": batch.column(0), "version": batch.column(3),
                    "band": [name if name is not None else found for
                             name, found in zip(
                                 batch.column(2).to_pylist(), scripts)],
                    "script": scripts}
            for i, name in enumerate(FIELDS):
                made[name] = [row[i] for row in rows]
            return made
        return work
    return map_arrow(rows, f"doc_id {kind}, version bigint, band string, script string, "
                     + ", ".join(
        f"{n} {'double' if n in MEASURES else 'bigint'}" for n in FIELDS),
        None, setup)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines",
          "n_repeat_words", "n_tokens", *MEASURES)


def _row(text, content, ids, sizes, counts, starts, flat, is_byte):
    words = len(ids)
    blanks = len(content) - len(content.translate(None, b" \t\n\v\f\r"))
    chars = len(text or "") - blanks
    row = [words, chars,
           len(content) - len(content.translate(None, SYMBOLS)),
           duplicate_lines(content), repeat_words(ids)]
    if not words:
        return [*row, 0, None, None, None]
    n = counts[ids]
    total = int(n.sum())
    if not total:
        return [*row, 0, None, None, None]
    ends = n.cumsum()
    tokens = flat[np.repeat(starts[ids] - ends + n, n) + np.arange(total)]
    _, times = np.unique(tokens, return_counts=True)
    entropy = math.log2(total) - float(
        (times * np.log2(times)).sum()) / total
    return [*row, total, chars / int(sizes[ids].sum()),
            float(is_byte[tokens].mean()), entropy]


def quartiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _n, and for each measure the array [lower, upper] quartile).

    Values are rounded to a thousandth and counted, so that the quartiles
    are exact, and the same in every run, whatever the size of a group: a
    group has as many counts as there are values.
    """
    values = rows.select(*keys, F.inline(F.array(*[F.struct(
        F.lit(m).alias("_m"), F.round(m, 3).alias("_v"))
        for m in MEASURES]))).groupBy(*keys, "_m", "_v").agg(
        F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*keys, "_m")
    upto = group.orderBy("_v").rowsBetween(Window.unboundedPreceding,
                                           Window.currentRow)
    # texts without a measure count for the size of a group only
    placed = values.withColumns({
        "_all": F.sum("_c").over(group),
        "_known": F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")))
        .over(group),
        "_upto": F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")))
        .over(upto)})

    def quartile(m: str, share: float):
        return F.min(F.when((F.col("_m") == m) & (
            F.col("_upto") >= F.col("_known") * share), F.col("_v")))
    return placed.groupBy(*keys).agg(
        F.max("_all").alias("_n"),
        *[F.array(quartile(m, 0.25), quartile(m, 0.75)).alias(f"_{m}")
          for m in MEASURES])


def judge(scratch: Scratch, measured: DataFrame,
          fence: float = FENCE) -> DataFrame:
    """Add ``base_failed`` and ``kept`` by the bands of all rows.

    A band belongs to a language (the script where it is null) and to a
    class of lengths, powers of two of words, and reaches ``fence`` quartile
    distances beyond the quartiles, at least LEAST_REACH.  Equal texts of a
    class count once for its band.  A class with fewer than MIN_DOCUMENTS
    texts takes the band of the nearest length of its language that has so
    many, else of the nearest length of its script, else FIXED_BANDS; the
    entropy's reach then grows by a bit for each class between, which is what
    twice the tokens can add.  Rows without words have no measures and fail
    the base rule, which also fails rows with under MIN_WORDS words or more
    than MAX_REPEAT_PERCENT of them repeated.  Bands are one row per class.
    """
    rows = scratch.keep(measured.withColumn(
        "length_class", F.floor(F.log2(F.greatest("n_words", F.lit(1))))
        .cast("int")), "fertility")

    def measured_bands(key: str, rank: int) -> DataFrame:
        texts = rows.dropDuplicates([key, "length_class", "version"]).select(
            F.col(key).alias("_key"), F.col("length_class").alias("_class"),
            *MEASURES)
        return quartiles(texts, ["_key", "_class"]).where(
            F.col("_n") >= MIN_DOCUMENTS).withColumn("_rank", F.lit(rank))
    known = scratch.keep(measured_bands("band", 0).union(
        measured_bands("script", 1)), "known-bands")
    # one row per class; the nearest of the known bands of each
    classes = rows.select("band", "script", "length_class").distinct()
    apart = F.abs(F.col("length_class") - F.col("_class"))
    order = [F.col("_rank").asc_nulls_last(), apart, "_class"]
    near = [classes.join(known.where(F.col("_rank") == rank),
                         F.col(key) == F.col("_key"), "left")
            for rank, key in enumerate(("band", "script"))]
    bands = near[0].union(near[1]).withColumn("_at", F.row_number().over(
        Window.partitionBy("band", "script", "length_class").orderBy(*order))
    ).where("_at = 1").withColumn("_apart", apart.cast("double"))
    bands = scratch.keep(bands, "bands")
    inside = F.lit(True)
    for m in MEASURES:
        low, high = F.col(f"_{m}")[0], F.col(f"_{m}")[1]
        reach = F.greatest((high - low) * fence, F.lit(LEAST_REACH[m]))
        if m == "token_entropy":
            reach = reach + F.col("_apart")
        # null without a known band, then without a measure
        inside = inside & F.coalesce(
            F.col(m).between(low - reach, high + reach),
            F.col(m).between(*FIXED_BANDS[m]), F.lit(True))
    failed = ((F.col("n_words") < MIN_WORDS)
              | (F.col("n_repeat_words") * 100
                 > F.col("n_words") * MAX_REPEAT_PERCENT))
    return (rows.join(bands, ["band", "script", "length_class"], "left")
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & inside)
            .select("doc_id", "n_words", "word_chars", "n_symbols",
                    "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "band", "length_class", "n_tokens", *MEASURES))

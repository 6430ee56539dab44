"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of labelled text.
A text is compressed once with every dictionary; the language whose
dictionary leaves the fewest bytes wins, and a narrow margin rejects.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import (BooleanType, DoubleType, StringType,
                               StructField, StructType)

from cadenza.llm.common import map_arrow

UNDETERMINED = "und"
#: Bytes of dictionary per language: the bound on the labelled sample.
DICTIONARY_BYTES = 1 << 17
#: Texts that a dictionary is cut from, and code points taken of each.
SAMPLE_TEXTS = 512
SAMPLE_CHARS = 1024
#: A dictionary is made of different runs of so many words, the most frequent
#: last, so that no passage is learned by heart.
RUN_WORDS = 4
#: Long texts are compressed in blocks, so that the dictionary, and not the
#: text's own beginning, stays the model.
BLOCK_BYTES = 4096
LEVEL = 6
#: Smallest share of bytes that the winner saves over the next language.
MIN_MARGIN = 0.01

#: Everything that is no letter in ASCII becomes a blank.
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, the language with the most texts first."""
    dictionaries: dict[str, bytes]
    min_margin: float = MIN_MARGIN


def fit(docs: DataFrame, lang: str = "lang", text: str = "text",
        min_margin: float = MIN_MARGIN) -> Model:
    """Cut one dictionary per language from labelled rows of ``docs``.

    The sample is bounded: SAMPLE_TEXTS different texts per language, chosen
    by the hash of the text, at most SAMPLE_CHARS of each.  Rows without
    language or letter are no examples; copies count once.  No labelled row
    gives an empty model, which answers ``und``.
    """
    labelled = docs.select(
        F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keyed = labelled.withColumn("h", F.xxhash64("text"))
    sizes = {row["lang"]: row["n"] for row in keyed.groupBy("lang").agg(
        F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return Model({}, min_margin)
    # hashes below a language's limit hold about four times the sample
    limits = F.create_map(*[F.lit(v) for name, n in sizes.items() for v in (
        name, min(2 ** 63 - 1, -2 ** 63 + 2 ** 66 * SAMPLE_TEXTS
                  // max(n, 1)))])
    low = keyed.where(F.col("h") <= F.try_element_at(limits, F.col("lang")))
    first = Window.partitionBy("lang").orderBy("h")
    chosen = (low.select("lang", "h").distinct()
              .withColumn("n", F.row_number().over(first))
              .where(F.col("n") <= SAMPLE_TEXTS).select("lang", "h"))
    # bounded by languages x SAMPLE_TEXTS, whatever the number of rows
    samples = (low.join(F.broadcast(chosen), ["lang", "h"])
               .groupBy("lang", "h")
               .agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("t")))
    runs: dict[str, Counter] = {}
    for row in samples.toLocalIterator():
        words = plain(row["t"]).split()
        runs.setdefault(row["lang"], Counter()).update(
            {b" ".join(words[i:i + RUN_WORDS])
             for i in range(0, len(words), RUN_WORDS)})
    names = sorted(runs, key=lambda name: (-sizes[name], name))
    return Model({name: b" ".join(sorted(
        runs[name], key=lambda run: (runs[name][run], zlib.crc32(run), run)
    ))[-DICTIONARY_BYTES:] for name in names}, min_margin)


def plain(text: str) -> bytes:
    """Lower-case UTF-8 with blanks for ASCII digits and marks."""
    return b" ".join(text.lower().encode("utf-8", "replace")
                     .translate(_PLAIN).split())


class Classifier:
    """A model with its compressors loaded, for use inside a task."""

    def __init__(self, model: Model):
        self.names = list(model.dictionaries)
        self.min_margin = model.min_margin
        self._compress = [self._coder(model.dictionaries[n])
                          for n in self.names]

    @staticmethod
    def _coder(content: bytes):
        shape = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=BLOCK_BYTES, dict_size=len(content),
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=False, write_checksum=False,
            write_dict_id=False)
        words = zstandard.ZstdCompressionDict(
            content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=shape)
        return zstandard.ZstdCompressor(
            dict_data=words, compression_params=shape).compress

    def sizes(self, text: str) -> list[int]:
        content = plain(text)
        blocks = [content[i:i + BLOCK_BYTES]
                  for i in range(0, len(content), BLOCK_BYTES)]
        return [sum(len(code(b)) for b in blocks) for code in self._compress]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); see ``identify``."""
        if text is None or not self.names or not any(
                map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(sizes) == 1:
            return self.names[best], 1.0, False
        rest = min(s for i, s in enumerate(sizes) if i != best)
        score = 1.0 - sizes[best] / rest if rest else 0.0
        return self.names[best], score, score < self.min_margin


FIELDS = [StructField("lang_pred", StringType()),
          StructField("score", DoubleType()),
          StructField("rejected", BooleanType())]


def identify(docs: DataFrame, model: Model, text: str = "text",
             drop_text: bool = False) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to every row.

    The whole text counts.  ``lang_pred`` is a learned language, or ``und``
    (score 0, rejected) for a null or empty text, one without a letter, or a
    model without languages.  ``score`` is the share of bytes that the winner
    saves over the next language (1 if there is only one); equal sizes go to
    the language with more labelled texts, with score 0.  ``rejected`` marks
    a score below the model's margin.  Columns of these names in ``docs`` are replaced;
    repeated rows get equal answers; an empty table stays empty.
    """
    names = [f.name for f in FIELDS]
    kept = [c for c in docs.columns
            if c not in names and not (drop_text and c == text)]
    read = kept if text in kept else [*kept, text]
    schema = StructType([*(docs.schema[c] for c in kept), *FIELDS])

    def setup():
        classifier = Classifier(model)

        def work(batch: pa.RecordBatch) -> dict:
            found = [classifier.predict(t) for t in
                     batch.column(read.index(text)).to_pylist()]
            made = {c: batch.column(i) for i, c in enumerate(kept_read)}
            for i, name in enumerate(names):
                made[name] = [f[i] for f in found]
            return {c: made[c] for c in schema.fieldNames()}
        kept_read = read
        return work
    return map_arrow(docs.select(*[f"`{c}`" for c in read]), schema, None,
                     setup)


def held_out(doc_id: Column) -> Column:
    """True for the documents that training never sees: one in five."""
    return F.crc32(doc_id.cast("string")) % 5 == 0

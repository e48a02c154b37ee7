"""Language identification by compression.

Each language owns a raw-content zstandard dictionary made of training texts.
A text is compressed once with each dictionary; the language whose dictionary
leaves the fewest bytes is chosen, and the choice is rejected when the runner-up
is nearly as good.  Long texts are compressed whole, in blocks, so that the
dictionary and not the text's own beginning decides everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import released, texts
from .storage import prepare

UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries in order of preference at ties: most training rows first, then by name."""

    names: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = 6
    block: int = 8192
    margin: float = 0.001


def _fold(text: str) -> bytes:
    return text.lower().encode()


def learn(
    df: DataFrame, text: str, lang: str, train: Column, rows_per_language: int = 500, piece_chars: int = 16_384, dictionary_bytes: int = 1 << 18, margin: float = 0.001
) -> LanguageModel:
    """Build the dictionaries from rows where ``train`` holds and the language is known.

    The sample is bounded: for each language the ``rows_per_language`` texts with the
    smallest hashes, without copies, until ``dictionary_bytes`` are reached.  Of a
    text of more than ``piece_chars`` characters so many teach, from a place that its
    hash gives.  Texts that dictionaries made of the other half of the sample assign to
    another language are taken as mislabelled and left out.  How often a language
    occurs is counted over all training rows.  Null and empty texts teach nothing.
    """
    rows = df.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).where(train & F.col(lang).isNotNull())
    hashed = rows.withColumn("_hash", F.when(F.octet_length("_text") > 0, F.xxhash64("_text")))
    found = hashed.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("_hash").alias("d")).collect()
    counts = {r["_lang"]: r["n"] for r in found}
    # Only texts with small hashes go on, a few times as many different ones as are wanted of each language.
    shares = [F.lit(x) for r in found for x in (r["_lang"], min(1.0, 4 * rows_per_language / max(1, r["d"])))]
    wanted = F.pmod("_hash", F.lit(1 << 30)) < F.try_element_at(F.create_map(*shares), F.col("_lang")) * float(1 << 30) if shares else F.lit(False)
    spare = F.length("_text") - F.lit(piece_chars)
    place = (F.pmod(F.shiftrightunsigned("_hash", 20), F.greatest(spare, F.lit(0)) + F.lit(1)) + F.lit(1)).cast("int")
    piece = F.when(spare > 0, F.substring("_text", place, F.lit(piece_chars))).otherwise(F.col("_text"))
    few = hashed.where(F.col("_hash").isNotNull() & wanted).select("_lang", "_hash", piece.alias("_text")).dropDuplicates(["_lang", "_hash"])
    first = Window.partitionBy("_lang").orderBy(F.pmod("_hash", F.lit(1 << 30)), "_hash")
    sample = few.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= rows_per_language)
    chosen: dict[str, dict[str, None]] = {}
    for r in sample.orderBy("_lang", "_place").collect():
        chosen.setdefault(r["_lang"], {})[r["_text"]] = None
    names = sorted(chosen, key=lambda name: (-counts[name], name))
    half = [_Classifier(_model(names, [list(chosen[x])[k::2] for x in names], dictionary_bytes, margin)) for k in (0, 1)]
    kept = [[t for i, t in enumerate(chosen[x]) if half[1 - i % 2].classify(t)[0] == x] or list(chosen[x]) for x in names]
    return _model(names, kept, dictionary_bytes, margin)


def _model(names: list[str], samples: list[list[str]], dictionary_bytes: int, margin: float) -> LanguageModel:
    made = []
    for sample in samples:
        size, parts = 0, []
        for one in map(_fold, sample):
            if size >= dictionary_bytes:
                break
            parts.append(one)
            size += len(one) + 1
        made.append(b"\n".join(reversed(parts))[-dictionary_bytes:])
    return LanguageModel(tuple(names), tuple(made), margin=margin)


class _Classifier:
    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.compressors = []
        for data in model.dictionaries:
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=model.level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, level=model.level, write_content_size=False, write_dict_id=False))

    def classify(self, text: str) -> tuple[str, float]:
        """Language and margin: the share of the runner-up's bytes that the winner saves."""
        if not self.compressors or not LETTER.search(text):
            return UNDETERMINED, 0.0
        data, step = _fold(text), self.model.block
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.model.names[0], 1.0
        return self.model.names[order[0]], 1.0 - sizes[order[0]] / sizes[order[1]]


def identify(df: DataFrame, key: str, text: str, model: LanguageModel) -> DataFrame:
    """(key, lang_pred, score, rejected) of every whole text.

    score is the margin, 0 to 1.  Null texts and texts without a letter are
    ``und`` with score 0, and rejected, as are margins under the model's.  Ties go
    to the more frequent training language.  Other columns are left out; repeated
    rows are judged each; an empty table gives no rows.
    """
    share = prepare(df.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = _Classifier(share.value)
        least = share.value.margin
        for batch in batches:
            for first, part in texts(batch.column(1)):
                found = [classifier.classify(x.decode()) for x in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        pa.array([x[0] for x in found], pa.string()),
                        pa.array([x[1] for x in found], pa.float64()),
                        pa.array([x[0] == UNDETERMINED or x[1] < least for x in found], pa.bool_()),
                    ],
                    ["key", "lang_pred", "score", "rejected"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(released(run), f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)


def keep_identified(df: DataFrame, text: str, model: LanguageModel) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose language is not rejected: a filter without a join."""
    share = prepare(df.sparkSession).sparkContext.broadcast(model)
    at_text = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = _Classifier(share.value)
        least = share.value.margin
        for batch in batches:
            found = [classifier.classify(x.decode()) for _, part in texts(batch.column(at_text)) for x in part]
            yield batch.filter(pa.array([x[0] != UNDETERMINED and x[1] >= least for x in found], pa.bool_()))

    return df.mapInArrow(released(run), T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]))

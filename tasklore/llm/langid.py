"""Language identification by compression (operator 7).

Each language has a zstandard raw-content dictionary made of a bounded sample of its labelled texts. A text's words,
lower-cased and without digits and marks, are cut into blocks of BLOCK bytes; each block is compressed with each
dictionary, and the language with the fewest bytes in all is chosen. Where the second language needs only a little
more, the text is compressed again at a stronger level; margins that stay narrow are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklore.llm.common import cut, in_arrow

#: Bounds of the training sample: texts a language, characters of each (from a place that its id decides), bytes a dictionary.
SAMPLE_TEXTS, SAMPLE_CHARS, DICT_BYTES = 300, 400, 112_640
BLOCK, LEVELS = 4096, (4, 12)
#: The share of its bytes by which the second language has to be behind for the first level to do.
CLEAR = 0.06
#: A text is rejected if the second language needs less than MARGIN of its bytes, or fewer than MARGIN_BYTES, more.
MARGIN, MARGIN_BYTES = 0.002, 1
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")
UNDETERMINED = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language of labelled (doc_id, text, lang), from the texts with the smallest hashes of their id.

    At most SAMPLE_TEXTS times SAMPLE_CHARS characters of each language reach the driver, and each sampled text has an
    equal share of the dictionary. Only texts whose hash is below what about four times SAMPLE_TEXTS have are sorted.
    """
    place = (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).alias("place")
    known = labelled.where(F.col("lang").isNotNull())
    counts = cut(known.groupBy("lang").agg((F.lit(4.0 * SAMPLE_TEXTS) / F.count("*")).alias("below")))  # of known size when joined
    start = F.floor(F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1)) + 1
    drawn = known.where(F.col("text").rlike(r"\p{L}")).select("lang", "doc_id", place, F.col("text").substr(start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", F.xxhash64("text"))
    sample = drawn.join(counts, "lang").where("place < below").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE_TEXTS)
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in sample.select("lang", "nth", "text").collect():
        texts.setdefault(row["lang"], []).append((row["nth"], row["text"]))
    return {k: b"".join(plain(t)[: max(DICT_BYTES // len(v), 1)] for _, t in sorted(v)) for k, v in sorted(texts.items())}


def plain(text: str) -> bytes:
    return f" {NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode()


class Classifier:
    def __init__(self, dicts: dict[str, bytes]):
        self.langs, self.dicts, self.packers = sorted(dicts), dicts, {}

    def sizes(self, raw: bytes, level: int) -> np.ndarray:
        import zstandard

        if level not in self.packers:
            self.packers[level] = []
            for lang in self.langs:
                own = zstandard.ZstdCompressionDict(self.dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(level=level)
                self.packers[level].append(zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False))
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return np.array([sum(len(p.compress(b)) for b in blocks) for p in self.packers[level]])

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (the share of the language's evidence, a byte less counting as one bit) and whether it is rejected."""
        if not text or not self.langs or not LETTER.search(text):
            return UNDETERMINED, 0.0, True
        raw = plain(text)
        for level in LEVELS:
            sizes = self.sizes(raw, level)
            best = int(sizes.argmin())
            gap = int(np.partition(sizes, 1)[1] - sizes[best]) if len(sizes) > 1 else len(raw)
            if gap >= CLEAR * (sizes[best] + gap) and gap >= 8:
                break
        score = float(1 / np.exp2(-np.minimum(sizes - sizes[best], 60.0)).sum())
        return self.langs[best], score, gap < MARGIN_BYTES or gap < MARGIN * (sizes[best] + gap)


def identify(docs: DataFrame, dicts: dict[str, bytes], keep: tuple = ()) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs (doc_id, text), and the columns in keep.

    A null text, or one without a letter, is `und`, score 0, rejected; so is every text if there are no dictionaries.
    Ties go to the first language by name, and are rejected. Repeats give repeats, an empty table an empty result.
    """
    kept = docs.select(*keep, "doc_id").schema.fieldNames()
    at = kept.index("text") if "text" in kept else len(kept)  # a kept text is not sent twice
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep, "doc_id").schema)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dicts)
        for batch in batches:
            found = pd.DataFrame([classify(x.as_py()) for x in batch.column(at)], columns=["lang_pred", "score", "rejected"])
            added = [pa.array(found["lang_pred"], pa.string()), pa.array(found["score"], pa.float64()), pa.array(found["rejected"], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *added], [*kept, "lang_pred", "score", "rejected"])

    given = docs.select(*keep, "doc_id", *([] if "text" in kept else [F.col("text").alias("_text")]))
    return in_arrow(given, predict, out + ", lang_pred string, score double, rejected boolean")

"""Language identification with language bitmasks in a bit-sliced Bloom filter.

Letter trigrams of words (with word edges) are counted per language. A trigram belongs to a
language if its relative frequency there is a good part of its highest one. The filter keeps one
bitmask of languages per slot, so ANDing the masks at a trigram's slots gives all languages that
hold it. Per language the hits of a text are counted and freed of the expected false positives;
the language with most hits is the answer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from urlvane.llm.shared import in_slices, mix, remainder, row_of, slices, utf8

UNDETERMINED = "und"
MAX_LANGUAGES = 64
#: A trigram rarer than this in a language is not learned, so a language has at most 1 / MIN_SHARE trigrams.
MIN_SHARE = 2e-5
#: A trigram belongs to a language if its frequency there is at least this part of its highest frequency.
RELATIVE = 0.35
HASHES = 3
SLOTS_PER_GRAM = 16
BLOCK = 1_000_000


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all rows, one space between rows, and where each row begins."""
    data, offsets = utf8(column)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    rows = len(offsets) - 1
    spaced = np.full(len(points) + rows + 1, 32, np.uint32)
    spaced[1 + np.arange(len(points)) + row_of(chars, len(points))] = _letters()[points]
    return spaced, chars + np.arange(rows + 1)


def _trigrams(column: pa.Array):
    """Blocks of (row, trigram) of all words of all rows, and at last the rows that have a letter."""
    points, starts = _code_points(column)
    rows = row_of(np.append(starts, len(points)) if starts[-1] < len(points) else starts, len(points))
    for first in range(0, max(len(points) - 2, 0), BLOCK):
        part = points[first:first + BLOCK + 2].astype(np.uint64)
        inside = np.flatnonzero(part[1:-1] != 32)
        gram = (part[inside] << np.uint64(42)) | (part[inside + 1] << np.uint64(21)) | part[inside + 2]
        yield rows[first + inside + 1], gram


def _slots(gram: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix(gram)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


def _count(batches):
    """Trigram counts per language of the rows of one task."""
    counts: dict[str, list[np.ndarray]] = {}

    def merged(parts):
        grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return grams, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

    for part in slices(batches):
        langs = part.column("lang").dictionary_encode()
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        for rows, gram in _trigrams(part.column("text")):
            for i, name in enumerate(names):
                own = counts.setdefault(name, [])
                own.append(np.unique(gram[code[rows] == i], return_counts=True))
                if len(own) > 16:
                    counts[name] = [merged(own)]
    for name, parts in counts.items():
        grams, n = merged(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    masks: np.ndarray
    false_positive: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from all rows with a text and a language.

    What reaches the driver is the filter itself: at most MAX_LANGUAGES / MIN_SHARE trigrams.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    per_lang = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(per_lang, "lang").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= MIN_SHARE)
    # one row per trigram: the languages that hold it
    held = share.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("langs"))
    kept = held.select("gram", F.transform(
        F.filter("langs", lambda x: x.share >= RELATIVE * F.col("top")), lambda x: x.lang).alias("langs"))
    found = kept.collect()
    languages = sorted({name for row in found for name in row.langs})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; a mask holds {MAX_LANGUAGES}")
    bit = {name: np.uint64(1 << i) for i, name in enumerate(languages)}
    size = 1 << max(10, int(SLOTS_PER_GRAM * max(len(found), 1)).bit_length())
    masks = np.zeros(size, np.uint64)
    if found:
        gram = np.array([row.gram for row in found], np.int64).view(np.uint64)
        own = np.array([np.bitwise_or.reduce([bit[x] for x in row.langs]) for row in found], np.uint64)
        for slot in _slots(gram, size):
            np.bitwise_or.at(masks, slot, own)
    filled = np.array([np.mean((masks >> np.uint64(i)) & np.uint64(1)) for i in range(len(languages))])
    return LanguageModel(languages, masks, filled ** HASHES)


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, lang_pred and score for every row.

    The score is the corrected share of the text's trigrams that the language holds. A text that is
    null or has no letter is `und` with score 0; ties go to the first name; with nothing learned all is `und`.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        n, k = part.num_rows, len(m.languages)
        hits, total = np.zeros((n, k)), np.zeros(n)
        for rows, gram in _trigrams(part.column("text")):
            total += np.bincount(rows, minlength=n)
            found = np.bitwise_and.reduce([m.masks[s] for s in _slots(gram, len(m.masks))])
            for i in range(k):
                hits[:, i] += np.bincount(rows[(found >> np.uint64(i)) & np.uint64(1) == 1], minlength=n)
        if not k:
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([UNDETERMINED] * n), pa.array(np.zeros(n))], ["doc_id", "lang_pred", "score"])
        freed = (hits - total[:, None] * m.false_positive) / (1 - np.minimum(m.false_positive, 0.99))
        best = freed.argmax(axis=1)
        share = np.clip(freed[np.arange(n), best] / np.maximum(total, 1), 0, 1)
        names = np.where(total > 0, np.array(m.languages, object)[best], UNDETERMINED)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(np.where(total > 0, share, 0.0))],
            ["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        in_slices(score), f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from documents outside the held-out fold (crc32 of the id modulo 5 is 0) and predict all."""
    model = train(docs.filter(remainder("doc_id", 5) != 0))
    found = predict(docs, model)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


#: Texts whose best language holds less than this share of their trigrams are in none of the languages.
MIN_SCORE = 0.15


def keep_identified(docs: DataFrame) -> DataFrame:
    """Drop documents without a language: no letters, or hardly a trigram of any language. Columns stay as they are.

    The model learns from all documents that carry a language.
    """
    model = train(docs)
    rejected = predict(docs, model).filter((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < MIN_SCORE))
    return docs.join(rejected.select("doc_id"), docs["doc_id"].eqNullSafe(rejected["doc_id"]), "left_anti")

"""Byte-level BPE by a tree reduction over pieces of text.

A text is halved until the parts are short; each part is encoded by itself. Two neighbours are
joined by encoding anew a window around the cut, which grows on both sides until it begins and
ends between a visible character and white space. The splitting pattern never lets a match run
over such a place and no match looks back, so tokens beyond the window stay as they are. The join
is associative, hence any tree gives the same ids. Decoding joins bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from urlvane.llm.shared import in_slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Longest part, in characters, that is encoded without being halved.
LEAF = 2048
#: Characters of the first window on either side of a cut; it doubles until it ends at a stable place.
WINDOW = 24
_STABLE = re.compile(r"(?<=\S)(?=\s)")


class Codec:
    """Ranks of a vocabulary file and what encoding and decoding need of them."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode_part = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        size = max(ranks.values()) + 1
        self.bytes_of = np.full(size, b"", object)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.digits = np.array([str(i) for i in range(size)], object)
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)

    def encode(self, text: str, first: int = 0, last: int | None = None) -> list[int]:
        last = len(text) if last is None else last
        if last - first <= LEAF:
            return self.encode_part(text[first:last])
        cut = (first + last) // 2
        return self.join(text, first, cut, last, self.encode(text, first, cut), self.encode(text, cut, last))

    def join(self, text: str, first: int, cut: int, last: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[first:last] from the ids of its two parts."""
        size = WINDOW
        begin = end = None
        while begin is None or end is None:
            if begin is None:
                low = max(first, cut - size)
                places = [m.start() for m in _STABLE.finditer(text, low, cut)]
                begin = places[-1] if places else (first if low == first else None)
            if end is None:
                high = min(last, cut + size)
                place = _STABLE.search(text, cut + 1, high)
                end = place.start() if place and place.start() < high else (last if high == last else None)
            size *= 2
        # outside [begin, end) both sides already hold the ids of the whole
        kept = len(left) - len(self.encode_any(text, begin, cut))
        dropped = len(self.encode_any(text, cut, end))
        return left[:kept] + self.encode_any(text, begin, end) + right[dropped:]

    def encode_any(self, text: str, first: int, last: int) -> list[int]:
        return self.encode_part(text[first:last]) if last > first else []

    def decode(self, ids, first: int = 0, last: int | None = None) -> bytes:
        last = len(ids) if last is None else last
        if last - first <= LEAF:
            return b"".join(self.bytes_of[ids[first:last]])
        cut = (first + last) // 2
        return self.decode(ids, first, cut) + self.decode(ids, cut, last)


@cache
def codec(path: str = RANKS) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str = RANKS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id and ids (array<int>) for every row; null and empty texts have no ids."""
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        in_slices(run), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """Return doc_id and bytes (binary) for rows of doc_id and ids; null ids give null."""
    def run(batches):
        c = codec(path)
        for batch in batches:
            out = [None if ids is None else c.decode(np.asarray(ids, np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """Encode and decode every text; return doc_id, n_tokens and the digests of ids and decoded bytes."""
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        count, of_ids, of_bytes = [], [], []
        for text in part.column("text").to_pylist():
            ids = np.array(c.encode(text or ""), np.int64)
            count.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(c.digits[ids]).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        in_slices(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def keep_round_trips(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """Last stage of a pipeline: the columns of the documents with n_tokens and ids_sha256, for texts that come back whole."""
    taken = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256")]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        keep, count, of_ids = [], [], []
        for text in part.column("text").to_pylist():
            ids = np.array(c.encode(text or ""), np.int64)
            keep.append(c.decode(ids) == (text or "").encode())
            count.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(c.digits[ids]).encode()).hexdigest())
        out = pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(count, pa.int64()), pa.array(of_ids, pa.string())], [*taken, "n_tokens", "ids_sha256"])
        return out.filter(pa.array(keep, pa.bool_()))

    rows = docs.select(*taken)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(in_slices(run), f"{kinds}, n_tokens long, ids_sha256 string")

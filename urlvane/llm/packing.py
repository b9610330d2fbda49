"""Cost-balanced packing of token ids into training sequences.

A task encodes its documents one after another and cuts whole sequences off the long ones. What is left of
each document waits in a buffer of bounded size. A full buffer is packed: its tokens are dealt exact room, as
many full sequences as they fill and, for what is over, sequences whose sizes are the binary digits of the rest,
so that no sequence needs padding. The remainders, longest first, go to the sequence of lowest estimated cost
(linear in tokens plus quadratic in each piece's length, as attention within a piece is) that has room; where no
sequence has room, the piece is cut at the roomiest one and its rest takes its place in the order again.

There is no shuffle, no key and no group: a task's memory is its buffer, a lost task is run again by itself, and
a third of all rows under one key are rows like any other.
"""

from __future__ import annotations

import heapq
import re
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from urlvane.llm.shared import slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CAPACITY = 2048
END_ID = 1
#: Tokens that wait in a task before they are packed.
BUFFER = 1 << 20
#: Weight of a piece's squared length against its length in the cost.
QUADRATIC = 1 / 4096
_SPECIAL = "<|endoftext|>"
#: Characters on whose classes both libraries agree: all assigned long ago.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-ſ‐-‧‰-›€]*")


class Encoder:
    """Ids as the tokenizers library gives them.

    Plain texts without the special token take the faster library that has the same vocabulary as ranks; tests
    compare the two. Every other text is encoded by the tokenizers library itself.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.fast = None
        if ranks:
            from urlvane.llm.byte_bpe import codec

            self.fast = codec(ranks).encode

    def __call__(self, text: str) -> list[int]:
        if self.fast and _SPECIAL not in text and _PLAIN.fullmatch(text):
            return self.fast(text)
        return self.exact.encode(text, add_special_tokens=False).ids


@cache
def encoder(vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(vocabulary, ranks)


def cost(length, quadratic: float = QUADRATIC):
    return length + quadratic * length * length


def deal(lengths: np.ndarray, capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pack pieces of the given lengths (1 to capacity - 1) without padding.

    Return tuples (piece, start within it, length, sequence, offset in the sequence). Ties go to the earlier
    piece and the earlier sequence. All sequences are full, or their sizes are powers of two.
    """
    total = int(lengths.sum())
    sizes = [capacity] * (total // capacity)
    rest = total % capacity
    sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    room, spent = np.array(sizes, np.int64), np.zeros(len(sizes))
    waiting = [(-int(n), i, 0) for i, n in enumerate(lengths)]
    heapq.heapify(waiting)
    out = []
    while waiting:
        negative, piece, start = heapq.heappop(waiting)
        length = -negative
        fits = room >= length
        if fits.any():
            to, taken = int(np.where(fits, spent, np.inf).argmin()), length
        else:
            to = int(room.argmax())
            taken = int(room[to])
            heapq.heappush(waiting, (taken - length, piece, start + taken))
        out.append((piece, start, taken, to, sizes[to] - int(room[to])))
        room[to] -= taken
        spent[to] += cost(taken, quadratic)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY,
         ranks: str | None = RANKS, buffer: int = BUFFER, quadratic: float = QUADRATIC) -> DataFrame:
    """Return one row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Every row is a document, also rows of equal or null ids; their pieces
    are told apart by their sequences only. Texts are encoded whole, however long. An empty table gives no rows.
    Columns other than doc_id and text are not read. `capacity` must be a power of two. `ranks` must hold the same
    vocabulary, or be None.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches):
        encode = encoder(vocabulary, ranks)
        number = TaskContext.get().partitionId() << 32  # of the task's next sequence
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def batch(rows, kind):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k or kind) for c, k in zip(zip(*rows), kinds)], names)

        waiting, held, kind = [], 0, None  # of the buffer: (doc_id, start, ids, tokens of the document)

        def packed():
            nonlocal number
            dealt = deal(np.array([len(w[2]) for w in waiting], np.int64), capacity, quadratic)
            rows = [(waiting[i][0], waiting[i][1] + a, n, waiting[i][2][a:a + n].tobytes(), waiting[i][3], number + to, at)
                    for i, a, n, to, at in dealt]
            number += 1 + max(d[3] for d in dealt)
            return batch(rows, kind)

        for part in slices(batches):
            kind = part.column("doc_id").type
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    rows.append((doc_id, start, capacity, ids[start:start + capacity].tobytes(), len(ids), number, 0))
                    number += 1
                if whole < len(ids):
                    waiting.append((doc_id, whole, ids[whole:], len(ids)))
                    held += len(ids) - whole
                if held >= buffer:
                    yield packed()
                    waiting, held = [], 0
            if rows:
                yield batch(rows, kind)
        if waiting:
            yield packed()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The rows of `pack` with the checksum of the ids in the place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

"""Packing against the tokenizer library and the rules of a sequence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlvane.llm import packing

TEXTS = [
    None, "", "a", "Ein Satz — mit Strich, und noch einer. " * 40, "x<|endoftext|>y", "日本語の文章 " * 30, "  \x85\x0b tab\t\n\n  ends ",
    "word " * 9000, "z" * 5000, "Don't we'll I'M 'S 12345 ½ ²³ …", "same text", "same text",
]


def rows_of(spark, texts, **more):
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for name, value in more.items():
        docs = docs.withColumn(name, value)
    return docs


def checked_pieces(pieces, capacity):
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for held in sequences.values():
        held.sort(key=lambda p: p.offset)
        at = 0
        for p in held:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    return sequences


@pytest.mark.parametrize("buffer", [packing.BUFFER, 700])
def test_pieces_hold_each_id_once(spark, buffer):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.VOCABULARY)
    docs = rows_of(spark, TEXTS, start=F.lit("clash"), ids=F.lit(1))
    pieces = packing.pack(docs, capacity=256, buffer=buffer).collect()
    checked_pieces(pieces, 256)
    found = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.doc_tokens, p.start)):
        found.setdefault(p.doc_id, []).append((p.start, p.doc_tokens, tuple(np.frombuffer(p.ids, "<u4"))))
    for doc_id in {i // 2 for i in range(len(TEXTS))}:
        wanted = sorted([*exact.encode(t or "", add_special_tokens=False).ids, 1] for t in TEXTS[2 * doc_id:2 * doc_id + 2])
        lengths = sorted(len(w) for w in wanted)
        assert sum(len(ids) for _, _, ids in found[doc_id]) == sum(lengths)
        if lengths[0] != lengths[1]:
            for want in wanted:
                got = [(start, ids) for start, total, ids in found[doc_id] if total == len(want)]
                assert [i for _, ids in got for i in ids] == want
                assert [start for start, _ in got] == [sum(len(x) for _, x in got[:k]) for k in range(len(got))]


def test_fast_ids_are_the_libraries_ids():
    encode = packing.encoder()
    dice = np.random.default_rng(3)
    letters = [chr(c) for c in range(0x2100) if packing._PLAIN.fullmatch(chr(c))] + list("etaoin'  \n") * 40
    for size in dice.integers(0, 400, 400):
        text = "".join(dice.choice(letters, size))
        assert encode.fast(text) == encode.exact.encode(text, add_special_tokens=False).ids


def test_descending_to_the_lowest_cost_that_has_room():
    dealt = packing.deal(np.array([100, 900, 900, 200, 1996]), 2048)
    assert [d[:4] for d in dealt][:3] == [(4, 0, 1996, 0), (1, 0, 900, 1), (2, 0, 900, 1)]
    assert sum(d[2] for d in dealt) == 4096
    lengths = np.random.default_rng(5).integers(1, 2048, 4000)
    dealt = packing.deal(lengths)
    taken = np.bincount([d[0] for d in dealt], [d[2] for d in dealt])
    assert (taken == lengths).all()
    assert len(dealt) - len(lengths) <= max(d[3] for d in dealt) + 1  # at most about one cut a sequence


def test_empty_table_and_null_ids(spark):
    assert packing.pack(rows_of(spark, [])).count() == 0
    row = packing.pack(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert (row.doc_id, row.length, row.doc_tokens, bytes(row.ids)) == (None, 1, 1, b"\1\0\0\0")
    with pytest.raises(ValueError):
        packing.pack(rows_of(spark, []), capacity=1000)


def test_many_small_partitions(spark):
    docs = rows_of(spark, [f"text number {i} " * (i % 50) for i in range(300)]).repartition(7)
    pieces = packing.pack(docs, capacity=512).collect()
    checked_pieces(pieces, 512)
    assert sum(p.start == 0 for p in pieces) == 300

"""Spelling groups against plain computations over all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlvane.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(counts: dict[str, int], ratio: int = 5):
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def plain_counts(rows, least_length=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= least_length:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def made_up(seed: int, size: int, syllables: list[str]) -> dict[str, int]:
    dice = np.random.default_rng(seed)
    counts = {}
    while len(counts) < size:
        word = "".join(dice.choice(syllables, dice.integers(3, 6)))
        counts[word] = int(5 * 6 ** dice.integers(0, 5))
        for _ in range(dice.integers(0, 4)):  # a few edits, some upon edits
            at, c = int(dice.integers(0, len(word))), str(dice.choice(list("aeé÷×zÿ")))
            word = [word[:at] + word[at + 1:], word[:at] + c + word[at:], word[:at] + c + word[at + 1:]][dice.integers(0, 3)]
            if len(word) >= 6:
                counts.setdefault(word, int(dice.integers(5, 40)))
    return counts


@pytest.mark.parametrize("rare", [0, 5, 40, 10 ** 9])
def test_groups_are_those_of_all_pairs(spark, rare):
    counts = made_up(7, 600, ["tion", "ción", "an", "ee", "th", "keit", "a", "b"])
    found = {tuple(r) for r in spelling.variant_groups(frame(spark, counts), rare=rare).collect()}
    assert found == plain_groups(counts)


def test_repeated_letters(spark):
    words = {"a" * n: 5 ** (n - 4) for n in range(6, 12)} | {"ab" * n: 7 for n in range(3, 7)} | {"ba" * n: 7 for n in range(3, 7)}
    found = {tuple(r) for r in spelling.variant_groups(frame(spark, words), rare=2).collect()}
    assert found == plain_groups(words)


def test_bound_holds_for_every_edit():
    dice = np.random.default_rng(2)
    words = ["".join(dice.choice(list("aab"), dice.integers(3, 10))) for _ in range(150)]
    counts = Counter(p[i:i + q] for w in words for p in ["\x02" + w + "\x03"] for q in (2, 3) for i in range(len(p) - q + 1))
    for w in words:
        p = "\x02" + w + "\x03"
        grams = spelling.decompose(p, counts, rare=1)
        own = Counter(p[a:b] for a, b in grams)
        bound = spelling.affected(p, grams, counts, rare=1)
        for i in range(len(w) + 1):
            for other in [w[:i] + c + w[i:] for c in "abc"] + [w[:i] + w[i + 1:]] + [w[:i] + c + w[i + 1:] for c in "abc"]:
                q = "\x02" + other + "\x03"
                shared = own & Counter(q[a:b] for a, b in spelling.decompose(q, counts, rare=1))
                assert sum(shared.values()) >= len(grams) - bound


def test_words_of_texts(spark):
    rows = [(i, "Überzahl ÜBERZAHL straße×weg colour COLOUR x" * 3 + " naïvely") for i in range(400)]
    rows += [(3, "colour colour"), (None, "Nullish colours"), (5, None), (6, ""), (7, "longish" * 3000)] + [(None, "Nullish")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    counts = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert counts == plain_counts(rows)
    assert {tuple(r) for r in spelling.variant_groups(frame(spark, counts)).collect()} == plain_groups(counts)


def test_empty_table_and_short_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_groups(spelling.word_counts(empty)).count() == 0
    with pytest.raises(ValueError):
        spelling.near_words(frame(spark, {"ab": 5}))

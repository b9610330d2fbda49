"""Decontamination against a comparison of every item with every place of every text."""

import random

import pytest

from urlvane.llm import decontaminate

WORDS = [f"w{i}" for i in range(400)]


def plain(docs, items):
    found = {}
    for doc_id, text in docs:
        words = (text or "").split()
        for item_id, item in items:
            own = (item or "").split()
            size = min(len(own), decontaminate.STRETCH)
            for shift in range(-len(own) + 1, len(words)):
                agree = [int(0 <= shift + i < len(words) and words[shift + i] == w) for i, w in enumerate(own)]
                best = max((sum(agree[i:i + size]) for i in range(len(own) - size + 1)), default=0)
                if own and best >= 0.8 * size - 1e-9:
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), best)
    return found


def cases():
    rng = random.Random(4)
    items = [(n, " ".join(rng.sample(WORDS, n))) for n in range(1, 14)]
    items += [(None, " ".join(rng.sample(WORDS, 9))), (50, None), (51, ""), (6, " ".join(rng.sample(WORDS, 6)))]
    docs, number = [], 0
    for _, item in items:
        own = (item or "").split()
        for changes in [[], *[[i] for i in range(len(own))], *[[i, j] for i in range(len(own)) for j in range(i) if len(own) > 9]]:
            text = [f"x{number}" if i in changes else w for i, w in enumerate(own)]
            docs.append((number, " ".join([f"a{number}"] * (number % 3) + text + [f"b{number}"] * (number % 2))))
            number += 1
    docs += [(None, items[11][1]), (None, "nothing"), (7, items[12][1]), (7, "other words"), (8, None), (9, ""), (10, items[9][1]), (10, items[9][1])]
    return docs, items


@pytest.mark.parametrize("at_once", [decontaminate.SEEDS_AT_ONCE, 40])
def test_leaks_equal_a_plain_search(spark, monkeypatch, at_once):
    monkeypatch.setattr(decontaminate, "SEEDS_AT_ONCE", at_once)
    docs, items = cases()
    frame = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, item long, seed string")
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, words int")
    got = decontaminate.leaks(frame, bench).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    assert {(r.doc_id, r.item_id): r.matched for r in got} == plain(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    assert decontaminate.leaks(docs, full.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert decontaminate.leaks(full, items).count() == 0
    assert decontaminate.keep_clean(full, items).count() == 1

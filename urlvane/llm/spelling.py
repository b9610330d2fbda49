"""Groups of spelling variants by a variable-length gram index.

Words are padded by a mark on either side. The gram dictionary holds all grams of Q_MIN letters and, where such a
gram is frequent in the vocabulary, its extensions; longer grams are pruned away under rare ones. A word
decomposes into the longest gram of the dictionary that starts at each place, without those inside an earlier one.
A gram ends at the letter that makes it rare, so an edit changes only the grams that hold its place, and may
swallow grams to its right whose letters up to the last are frequent. The most over all edits is the word's bound
of affected grams: two words one edit apart share at least the larger of (grams - bound) of the two.

Merging lists: in the order rare to frequent, the same for all words, the first (bound + COMMON) grams of both words
hold COMMON common grams if they share that many at all. Lists are therefore kept by COMMON grams at once, with
their places and the word's length, and a word looks only into lists that one edit can align with it.
Words whose bound leaves fewer than COMMON grams are also searched among themselves by an index in which all
grams have Q_MIN letters. Found pairs are verified by their edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from urlvane.llm.shared import discard, slices, written

Q_MIN, Q_MAX = 2, 3
#: A gram in more places of the vocabulary than this is extended.
RARE = 200
#: Grams that two words must share to be compared.
COMMON = 2
#: Distinct words a task counts before it gives them out.
COUNTED = 300_000
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_OPEN, _CLOSE = "\x02", "\x03"


def runs(text: str) -> list[str]:
    """Maximal runs of letters, A-Z lowered."""
    return _RUN.findall(text.encode().translate(_LOWER).decode())


def seeded(doc_id, run: str, one_in: int) -> str:
    """The run as the document has it: one in `one_in` pairs of document and run loses a letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int | None = 199) -> DataFrame:
    """Rows (word, n) of words with at least that many letters and occurrences in all texts.

    Null and empty texts have no words. Rows of equal ids all count; a null id counts as an empty one. With
    one_in=None, words are the runs themselves.
    """
    def run(batches):
        counts: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_pydict(
            {"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                for found, n in Counter(r for r in runs(text or "") if len(r) >= least_length).items():
                    word = seeded(doc_id, found, one_in) if one_in else found
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How often each gram of Q_MIN to Q_MAX letters occurs in the padded words.

    The alphabet has 92 letters and marks, so that there are at most 92 ** 2 + 92 ** 3 grams, however many words.
    """
    padded = words.select(F.concat(F.lit(_OPEN), "word", F.lit(_CLOSE)).alias("w"))
    cut = [F.transform(F.sequence(F.lit(1), F.length("w") - q + 1), lambda at, q=q: F.substring("w", at, F.lit(q)))
           for q in range(Q_MIN, Q_MAX + 1)]
    grams = padded.select(F.explode(F.flatten(F.array(*cut))).alias("gram"))
    return {row.gram: row.n for row in grams.groupBy("gram").agg(F.count("*").alias("n")).toLocalIterator()}


def decompose(padded: str, counts: dict[str, int], q_max: int = Q_MAX, rare: int = RARE) -> list[tuple[int, int]]:
    """(start, end) of the grams of a padded word."""
    size, out, covered = len(padded), [], 0
    for start in range(size - Q_MIN + 1):
        end = start + Q_MIN
        while end < size and end - start < q_max and counts.get(padded[start:end], 0) > rare:
            end += 1
        if end > covered:
            out.append((start, end))
            covered = end
    return out


def affected(padded: str, grams: list[tuple[int, int]], counts: dict[str, int], q_max: int = Q_MAX, rare: int = RARE) -> int:
    """Most grams that one inserted, deleted or replaced letter can take from the decomposition.

    A replaced or deleted letter i takes the grams that hold it; a letter inserted before i those that hold both
    i - 1 and i. Of the grams right of it, one with end e may be swallowed by a gram that starts at the edit or
    before: that gram is no longer than q_max, and its letters between the edit and e - 1 are frequent or few.
    """
    def swallowed(first: int) -> int:
        return sum(a >= first and b - first < q_max and (b - 1 - first < Q_MIN or counts.get(padded[first:b - 1], 0) > rare)
                   for a, b in grams)

    most = 0
    for i in range(1, len(padded)):
        if i < len(padded) - 1:
            most = max(most, sum(a <= i < b for a, b in grams) + swallowed(i + 1))
        most = max(most, sum(a < i < b for a, b in grams) + swallowed(i))
    return most


def listed(word: str, counts: dict[str, int], q_max: int = Q_MAX, rare: int = RARE) -> tuple[list[tuple[str, int, str, int]], bool]:
    """The word's keys, COMMON grams with places from left to right, and whether its bound leaves that many grams."""
    padded = _OPEN + word + _CLOSE
    grams = decompose(padded, counts, q_max, rare)
    bound = affected(padded, grams, counts, q_max, rare)
    named = sorted(((padded[a:b], a) for a, b in grams), key=lambda g: (counts.get(g[0], 0), g))
    pairs = [sorted(two, key=lambda g: g[1]) for two in combinations(named[:bound + COMMON], COMMON)]
    return [(*one, *two) for one, two in pairs], len(grams) - bound >= COMMON


def _lists(words: DataFrame, counts: dict[str, int], q_max: int, rare: int) -> DataFrame:
    """Rows (word, letters, one, at_one, two, at_two, sure) of the index. The counts reach each executor once.

    letters has a bit for each letter that the word holds.
    """
    shared = words.sparkSession.sparkContext.broadcast(counts)
    names = ["word", "letters", "one", "at_one", "two", "at_two", "sure"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_()]

    def run(batches):
        for batch in batches:
            rows = [(word, bits, *key, sure) for word in batch.column("word").to_pylist()
                    for bits in [sum({1 << ord(c) % 61 for c in word})]
                    for keys, sure in [listed(word, shared.value, q_max, rare)] for key in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    return words.select("word").mapInArrow(
        run, "word string, letters long, one string, at_one int, two string, at_two int, sure boolean")


def _candidates(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of words with a key in common that one edit can align; a is the shorter or the smaller word.

    An edit that changes the length moves the grams right of it by one place. A word looks into the lists of its own
    length at the same places, and into those of words one letter shorter, its last grams moved by one place or not.
    Words that hold more than two letters unlike are no pair.
    """
    key = lambda size, one, two: F.xxhash64("one", "two", size, one, two).alias("key")
    size, one, two = F.length("word"), F.col("at_one"), F.col("at_two")
    own = lists.select(F.col("word").alias("a"), F.col("letters").alias("in_a"), key(size, one, two))
    looks = lists.select(F.col("word").alias("b"), F.col("letters").alias("in_b"), F.explode(F.array(
        key(size, one, two), key(size - 1, one, two), key(size - 1, one, two - 1), key(size - 1, one - 1, two - 1))).alias("key"))
    met = own.join(looks, "key").filter(F.bit_count(F.col("in_a").bitwiseXOR(F.col("in_b"))) <= 2)
    return met.filter((F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))).select("a", "b")


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs one edit apart. The edit leaves the first or the second half of the shorter word a as it is."""
    whole_half = F.expr("left(a, length(a) div 2) = left(b, length(a) div 2) OR "
                        "right(a, length(a) - length(a) div 2) = right(b, length(a) - length(a) div 2)")
    return pairs.filter(whole_half).filter(F.levenshtein("a", "b", 1) == 1).distinct()


def near_words(words: DataFrame, rare: int = RARE) -> DataFrame:
    """Pairs (a, b), once each, of distinct words that differ by one inserted, deleted or replaced letter.

    Words have at least three letters; a is the shorter word, or the smaller of equally long ones.
    """
    if words.filter(F.length("word") < 3).limit(1).count():
        raise ValueError("words must have three letters at least")
    lists = written(_lists(words, gram_counts(words), Q_MAX, rare), "gram-lists")
    unsure = lists.filter("NOT sure").select("word").distinct()
    pairs = _candidates(lists).unionByName(_candidates(_lists(unsure, {}, Q_MIN, rare)))
    found = written(_verified(pairs), "near-words")
    discard(lists)
    return found


def variant_groups(counts: DataFrame, ratio: int = 5, rare: int = RARE) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for rows (word, n) of distinct words.

    form: the near word of largest n, of equal ones the smallest in code-point order, if its n is at least `ratio`
    times the word's; else null. root: the last word when forms are followed from the word, itself if it has none.
    n_near: its near words. An empty table gives no rows. Forms grow by the ratio at each step, so chains are short;
    they are followed by doubling steps.
    """
    words = written(counts.select("word", "n"), "words")
    near = near_words(words, rare)
    both = near.union(near.select("b", "a")).toDF("word", "other")
    others = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(others, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    chosen = words.join(best, "word", "left").withColumn("taken", -F.col("best.less") >= ratio * F.col("n"))
    chosen = written(chosen.select(
        "word", F.when(F.col("taken"), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("taken"), -F.col("best.less")).alias("form_n")), "forms")
    steps = written(chosen.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not steps.join(onward, "root", "left_semi").limit(1).count():
            break
        before, steps = steps, written(
            steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        discard(before)
    return chosen.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Toxicity from a lexicon that is matched with misspellings, in context.

Terms are learned from labelled documents: whole words, and beginnings of words. They form a trie.
Its product with a Levenshtein automaton of one edit is made deterministic once, so all words of a
batch walk through one table, a character at a time. Matches are then read in their context: inside
quotation marks or after a reporting word they count as quoted; matches close to each other or to
an address in the second person speak for abuse. A logistic model turns this into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from urlvane.llm.language_id import _code_points, _letters
from urlvane.llm.shared import in_slices, remainder, row_of, written

#: Labelled documents per class that the lexicon and the model are fitted on; the first by a hash of the id.
FIT_ROWS = 5000
#: Files that the texts of those documents are written to, so that as many tasks share the fit.
FIT_FILES = 16
#: A term is in this part of the toxic documents at least ...
MIN_SUPPORT = 0.004
#: ... and so many times as frequent there as in the others.
MIN_ODDS = 60
STEMS = (4, 5, 6, 7)
#: Terms of fewer letters must match exactly.
FUZZY_FROM = 5
WINDOW_WORDS = 12
THRESHOLD = 0.3
REPORTING = ("said", "says", "quote", "quoted", "called", "wrote", "word", "term", "dit", "sagte", "dijo", "wort", "mot", "palabra")
SECOND_PERSON = ("you", "your", "u", "du", "dich", "tu", "te", "vous", "usted")
QUOTES = "\"“”„«»"
FEATURES = 7


@dataclass(frozen=True)
class Automaton:
    """step[state, class of the letter]; state 0 is dead, 1 the start. At a word's end: the weight of the
    best term (0: none) and whether it needed an edit."""

    letters: str
    step: np.ndarray
    weight: np.ndarray
    edited: np.ndarray


def build_automaton(terms: dict[str, float]) -> Automaton:
    """Terms with weights; a term that ends in * stands for all words that begin so."""
    children: list[dict[str, int]] = [{}]
    whole: dict[int, float] = {}
    stem: dict[int, float] = {}
    fuzzy = [False]

    for term, weight in sorted(terms.items()):
        node, letters = 0, term.rstrip("*")
        for char in letters:
            if char not in children[node]:
                children[node][char] = len(children)
                children.append({})
                fuzzy.append(False)
            node = children[node][char]
            fuzzy[node] |= len(letters) >= FUZZY_FROM
        (stem if term.endswith("*") else whole)[node] = weight
    alphabet = sorted({c for kids in children for c in kids})

    def closed(states):
        """With the terms' letters that may be left out; of a node the fewest edits stay."""
        best: dict[int, int] = {}
        for node, edits in states:
            if edits < best.get(node, 2):
                best[node] = edits
            if edits == 0:
                for kid in children[node].values():
                    if fuzzy[kid] and node:  # the first letter stays
                        best.setdefault(kid, 1)
        return frozenset(best.items())

    def moved(states, char):
        for node, edits in states:
            if char in children[node]:
                yield children[node][char], edits
            if edits == 0 and node:
                if any(fuzzy[k] for k in children[node].values()) or (fuzzy[node] and not children[node]):
                    yield node, 1  # a letter too many
                for other, kid in children[node].items():
                    if other != char and fuzzy[kid]:
                        yield kid, 1

    start = (closed([(0, 0)]), None)
    number = {(frozenset(), None): 0, start: 1}
    queue, rows = [start], [[0] * (len(alphabet) + 1)]
    for states, done in queue:
        row = []
        for char in [None, *alphabet]:
            after = closed(moved(states, char))
            found = [(e, -stem[n]) for n, e in after if n in stem] + ([done] if done else [])
            key = (after, min(found) if found else None)
            if key not in number:
                number[key] = len(number)
                queue.append(key)
            row.append(number[key])
        rows.append(row)
    weight, edited = np.zeros(len(number)), np.zeros(len(number), bool)
    for (states, done), i in number.items():
        found = [(e, -whole[n]) for n, e in states if n in whole] + ([done] if done else [])
        if found:
            edits, value = min(found)
            weight[i], edited[i] = -value, edits > 0
    return Automaton("".join(alphabet), np.array(rows, np.int32), weight, edited)


def match_words(auto: Automaton, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The state each word ends in, for lower-case letters `points` and the words' bounds."""
    classes = np.zeros(0x110000, np.int32)
    for i, char in enumerate(auto.letters):
        classes[ord(char)] = i + 1
    state = np.ones(len(start), np.int32)
    live, j = np.arange(len(start)), 0
    while len(live):
        state[live] = auto.step[state[live], classes[points[start[live] + j]]]
        j += 1
        live = live[(state[live] != 0) & (end[live] - start[live] > j)]
    return state


def _inside_quotes(text: str, places: np.ndarray) -> np.ndarray:
    """Whether an odd number of quotation marks stands between the line's beginning and each place."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], np.cumsum(np.isin(points, [ord(q) for q in QUOTES]))])
    line = np.concatenate([[0], np.flatnonzero(points == 10) + 1])
    return (before[places] - before[line[np.searchsorted(line, places, side="right") - 1]]) % 2 == 1


def _features(auto: Automaton, part: pa.RecordBatch) -> np.ndarray:
    """Per row: exact and edited weight, quoted matches, densest window, rate, addressed matches, length."""
    column = part.column("text")
    points, starts = _code_points(column)
    letter = points != 32
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    first = np.searchsorted(start, starts)
    rows = row_of(first, len(start))
    state = match_words(auto, points, start, end)
    n = part.num_rows
    out = np.zeros((n, FEATURES))
    words = np.diff(first)
    hits = np.flatnonzero(auto.weight[state] > 0)
    weight, edited, of = auto.weight[state[hits]], auto.edited[state[hits]], rows[hits]
    out[:, 0] = np.log1p(np.bincount(of[~edited], weight[~edited], minlength=n))
    out[:, 1] = np.log1p(np.bincount(of[edited], weight[edited], minlength=n))
    word = lambda i: "".join(map(chr, points[start[i]:end[i]]))
    open_quote = np.zeros(len(hits), bool)
    for row in np.unique(of):
        own = slice(*np.searchsorted(of, [row, row + 1]))
        open_quote[own] = _inside_quotes(column[int(row)].as_py(), start[hits[own]] - starts[row] - 1)
    for at, i in enumerate(hits):
        row = of[at]
        near = range(max(first[row], i - WINDOW_WORDS), min(first[row + 1], i + WINDOW_WORDS + 1))
        quoted = open_quote[at] or any(word(k) in REPORTING for k in near if i - 4 <= k < i)
        out[row, 2] += quoted
        out[row, 5] += any(word(k) in SECOND_PERSON for k in near if abs(k - i) <= 4)
        lo, hi = np.searchsorted(hits, [near.start, near.stop])
        out[row, 3] = max(out[row, 3], 0 if quoted else hi - lo)
    out[:, [2, 5]] = np.log1p(out[:, [2, 5]])
    out[:, 4] = np.log1p(100 * np.bincount(of, minlength=n) / np.maximum(words, 1))
    out[:, 6] = np.log1p(words)
    return out


def learn_terms(rows: DataFrame) -> dict[str, float]:
    """Terms and weights (log odds) from rows of text and toxic (0 or 1): all with the support and the odds.

    Counts are of documents. A beginning of words is dropped where longer terms account for it, and a term
    where a beginning of it is taken.
    """
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return {}
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    stems = [F.transform(F.filter("words", lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    terms = rows.select("toxic", words.alias("words")).select(
        "toxic", F.explode(F.array_distinct(F.concat("words", *stems))).alias("term"))
    counts = terms.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    odds = ((F.col("t") + 0.5) / (bad + 1)) / ((F.col("c") + 0.5) / (good + 1))
    found = counts.filter(F.col("t") >= max(3, MIN_SUPPORT * bad)).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS)
    best = found.collect()  # few: each is in a stated part of a bounded sample
    # whole words and longer beginnings first among equals, so that the narrowest reading of the data is taken
    order = sorted(best, key=lambda r: (-(r.t - 5 * r.c), r.term.endswith("*"), -len(r.term), r.term))
    taken: dict[str, tuple[float, int]] = {}
    for r in order:
        bare = r.term.rstrip("*")
        covered = any(bare.startswith(k[:-1]) for k in taken if k.endswith("*"))
        explained = r.term.endswith("*") and sum(t for k, (_, t) in taken.items() if k.startswith(bare)) >= 0.9 * r.t
        if not covered and not explained:
            taken[r.term] = (float(np.log(r.odds)), r.t)
    return {k: v for k, (v, _) in taken.items()}


def fitted_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """text and toxic of the documents that are fitted, and the number of labelled documents per class.

    They are chosen from labels alone, by a hash of the id, FIT_ROWS per class, and only their texts are read and
    written. Ids of no document, null ids and labels other than 0 and 1 do not count; a repeated id counts once, as
    toxic if one of its labels is, with the smallest of its texts.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id"), "doc_id", "left_semi")
    known = written(known, "toxicity-labels")
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    first = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS) for c in (0, 1)]
    chosen = first[0].unionByName(first[1])
    # at most 2 * FIT_ROWS ids
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL")
    sample = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).repartition(FIT_FILES, "doc_id")
    return written(sample.select("toxic", "text"), "toxicity-sample"), n


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Return doc_id and score (0 to 1) for every row of docs; labels has doc_id and toxic.

    At most FIT_ROWS labelled documents of each class (the first by a hash of their id) are fitted. Documents with
    a null text or label are not fitted. Null and empty texts get the probability of a text without a match; equal
    texts get equal scores. Without texts of both classes the score is the share of toxic ones among the labelled
    (0 if there are none). An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    sample, n = fitted_rows(docs, labels)
    fitted = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    share = n.get(1, 0) / max(sum(n.values()), 1)
    if len(fitted) < 2:
        return texts.select("doc_id", F.lit(float(share)).alias("score"))
    terms = learn_terms(sample)
    shared = docs.sparkSession.sparkContext.broadcast(build_automaton(terms))

    def measured(part: pa.RecordBatch) -> pa.RecordBatch:
        values = _features(shared.value, part)
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(values.tolist(), pa.list_(pa.float64()))], [part.schema.names[0], "features"])

    # classes weigh as they do among all labelled documents
    weight = F.when(F.col("toxic") == 1, n[1] / fitted[1]).otherwise(n[0] / fitted[0])
    train = sample.select("toxic", "text").mapInArrow(in_slices(measured), "toxic int, features array<double>")
    train = train.select(F.col("toxic").cast("double").alias("label"), array_to_vector("features").alias("features"), weight.alias("weight"))
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=60).fit(train)
    slope, bias = np.array(model.coefficients), float(model.intercept)

    def scored(part: pa.RecordBatch) -> pa.RecordBatch:
        z = np.clip(_features(shared.value, part) @ slope + bias, -40, 40)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    return texts.mapInArrow(in_slices(scored), f"doc_id {kind}, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels outside the held-out fold (crc32 of the id modulo 4 is 2) and score all documents."""
    found = score(docs, labels.filter(remainder("doc_id", 4) != 2))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""A hidden Markov language model, trained and applied on Spark.

Tokens are the words of a text (A-Z lowered) and one end. A state emits a class of words; a class
emits a word by its smoothed count. The most frequent words are classes of their own, all others
share a class with the words of like ending. Baum-Welch counts are made per partition, summed by
Spark, and give the next model; the forward recursion, scaled at each token, gives the exact
probability of a text. Texts are kept as chunks: the words of some thousand texts as indexes into
the chunk's own dictionary, so that a word costs one row per chunk when it is counted or looked up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from urlvane.llm.shared import blob, mix, pressed, slices, unpack, written
from urlvane.llm.words import Words

STATES = 8
#: Words that are a class of their own, and classes by ending.
TOP_WORDS = 4096
ENDINGS = 4096
ENDING_BYTES = 3
CHUNK_TOKENS = 1_000_000
#: Training walks pieces of at most so many tokens side by side; what a piece does to the state vector
#: is a product of matrices, by which the vectors are carried over the cuts, so counts are those of whole texts.
PIECE = 512
#: Tokens whose vectors are held at once.
STEP_TOKENS = 1 << 17
#: Products are scaled after so many tokens, long before they leave the range of doubles.
SCALE_EVERY = 8
#: First values come from texts of a bounded sample; then all training texts are passed.
FIRST_ROWS = 3000
FIRST_PASSES = 15
PASSES = 3
END = mix(np.array([0x0E0D], np.uint64))[0]
_CHUNK = ("chunk long, doc_ids array<{kind}>, held binary, sizes binary, tokens binary, words binary, endings binary, trained binary")


def _endings(words: Words) -> np.ndarray:
    key = np.zeros(len(words.end), np.uint64)
    for i in range(1, ENDING_BYTES + 1):
        inside = words.end - i >= words.start
        at = np.where(inside, words.end - i, 0)
        byte = words.data[at] if len(words.data) else np.zeros(len(at), np.uint8)
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        key = key * np.uint64(257) + np.where(inside, byte.astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(key) % np.uint64(ENDINGS)).astype(np.uint16)


def chunks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Rows of some thousand texts: per text its id, fold and length; the tokens; the dictionary with training counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(parts, number):
        ids = [i for p in parts for i in p[0]]
        held, sizes, hashes, ends = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
        words, first, tokens = np.unique(hashes, return_index=True, return_inverse=True)
        train = ~np.repeat(held, sizes)
        trained = np.bincount(tokens[train], minlength=len(words)).astype(np.int64)
        row = {"chunk": [number], "doc_ids": [ids], "held": [blob(held)], "sizes": [blob(sizes)],
               "tokens": [pressed(blob(tokens.astype(np.uint32)))], "words": [blob(words)], "endings": [blob(ends[first])],
               "trained": [blob(trained)]}
        return row

    def run(batches):
        task, number, waiting, total, id_type = TaskContext.get().partitionId(), 0, [], 0, None
        binary = lambda row: pa.RecordBatch.from_arrays(
            [pa.array(row["chunk"], pa.int64()), pa.array(row["doc_ids"], pa.list_(id_type)),
             *[pa.array(row[c], pa.binary()) for c in ("held", "sizes", "tokens", "words", "endings", "trained")]], list(row))
        for part in slices(batches):
            id_type = part.column("doc_id").type
            words = Words(part.column("text"))
            n = part.num_rows
            # each text's words, then its end
            at = np.arange(len(words.hash)) + words.row
            hashes, ends = np.full(len(at) + n, END, np.uint64), np.zeros(len(at) + n, np.uint16)
            hashes[at], ends[at] = words.hash, _endings(words)
            sizes = np.diff(words.first) + 1
            held = np.array(part.column("held").to_pylist(), bool)
            waiting.append((part.column("doc_id").to_pylist(), held, sizes, hashes, ends))
            total += len(hashes)
            if total >= CHUNK_TOKENS:
                yield binary(packed(waiting, (task << 32) + number))
                waiting, total, number = [], 0, number + 1
        if waiting:
            yield binary(packed(waiting, (task << 32) + number))

    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    return rows.mapInArrow(run, _CHUNK.format(kind=kind))


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class x state


@dataclass(frozen=True)
class Classes:
    """top: hashes of the words that are classes of their own, sorted. Other words: TOP + ending."""

    top: np.ndarray

    def of(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        if not len(self.top):
            return TOP_WORDS + endings.astype(np.int64)
        at = np.minimum(np.searchsorted(self.top, words), len(self.top) - 1)
        return np.where(self.top[at] == words, at, TOP_WORDS + endings.astype(np.int64))


def _live(lengths: np.ndarray) -> np.ndarray:
    """How many of the sequences, longest first, have a token at each place."""
    return np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")


def _steps(lengths: np.ndarray):
    """Bounds of runs of sequences of some STEP_TOKENS tokens together."""
    ends, lo = np.cumsum(lengths), 0
    while lo < len(lengths):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP_TOKENS, side="right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def _carried(model: Hmm, classes: np.ndarray, first: np.ndarray, length: np.ndarray, within: np.ndarray, last: np.ndarray):
    """For each piece, in the order of the texts: the scaled state vector before its first token (the start for
    a text's first piece) and the backward vector after its last one."""
    states = len(model.start)
    into, out = np.tile(model.start, (len(first), 1)), np.ones((len(first), states))
    cut = np.flatnonzero((within > 0) | ~last)
    cut = cut[np.argsort(-length[cut], kind="stable")]
    product = np.zeros((len(first), states, states)) if len(cut) else None
    for lo, hi in _steps(length[cut]):
        own = cut[lo:hi]
        live = _live(length[own])
        p = np.where((within[own] == 0)[:, None, None], np.eye(states), model.move)
        for t, n in enumerate(live):
            e = model.emit[classes[first[own[:n]] + t]][:, None, :]
            p[:n] = ((p[:n].reshape(-1, states) @ model.move).reshape(n, states, states) if t else p[:n]) * e
            if t % SCALE_EVERY == SCALE_EVERY - 1:
                p[:n] /= p[:n].sum(axis=(1, 2))[:, None, None]
        product[own] = p / p.sum(axis=(1, 2))[:, None, None]
    depth = np.argsort(within[cut], kind="stable")
    levels = np.split(cut[depth], np.flatnonzero(np.diff(within[cut][depth])) + 1) if len(cut) else []
    for own in levels[1:]:
        v = (into[own - 1][:, None, :] @ product[own - 1])[:, 0]
        into[own] = v / v.sum(axis=1)[:, None]
    for own in reversed(levels[1:]):
        v = (product[own] @ out[own][:, :, None])[:, :, 0]
        out[own - 1] = v / v.sum(axis=1)[:, None]
    return into, out


def expected(model: Hmm, classes: np.ndarray, sizes: np.ndarray, keep: np.ndarray):
    """Baum-Welch counts of the kept texts: start, move, emit (class x state), log10 likelihood."""
    states = len(model.start)
    start, move, like = np.zeros(states), np.zeros((states, states)), 0.0
    emit = np.zeros((len(model.emit), states))
    pieces = -(-sizes[keep] // PIECE)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    last = within == np.repeat(pieces, pieces) - 1
    first = np.repeat((np.cumsum(sizes) - sizes)[keep], pieces) + within * PIECE
    length = np.minimum(np.repeat(sizes[keep], pieces) - within * PIECE, PIECE)
    into, out = _carried(model, classes, first, length, within, last)
    order = np.argsort(-length, kind="stable")
    for lo, hi in _steps(length[order]):
        own = order[lo:hi]
        live, continues = _live(length[own]), within[own] > 0
        alpha, seen, scales = [], [], []
        for t, n in enumerate(live):
            obs = classes[first[own[:n]] + t]
            e = model.emit[obs]
            a = (alpha[-1][:n] @ model.move if t else np.where(continues[:, None], into[own] @ model.move, into[own])) * e
            s = a.sum(axis=1)
            a = a / s[:, None]
            like += np.log10(s).sum()
            alpha.append(a)
            seen.append((obs, e))
            scales.append(s)
        gammas, n = [None] * len(live), 0
        for t in range(len(live) - 1, -1, -1):
            # pieces that end here begin with the vector that is carried back to them
            ending = out[own[n:live[t]]]
            beta = np.empty((live[t], states))
            beta[n:] = ending / (ending * alpha[t][n:]).sum(axis=1)[:, None]
            if n:
                move += model.move * (alpha[t][:n].T @ weighted)
                beta[:n] = weighted @ model.move.T
            n = live[t]
            weighted = seen[t][1] * beta / scales[t][:, None]
            gammas[t] = alpha[t] * beta
        move += model.move * (into[own[continues]].T @ weighted[continues])
        start += gammas[0][~continues].sum(axis=0)
        obs, gamma = np.concatenate([o for o, _ in seen]), np.concatenate(gammas)
        for k in range(states):
            emit[:, k] += np.bincount(obs, gamma[:, k], minlength=len(emit))
    return start, move, emit, like


def forward(model: Hmm, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each text's classes, by the scaled forward recursion over its whole length."""
    total = np.zeros(len(sizes))
    if not len(sizes):
        return total
    order = np.argsort(-sizes, kind="stable")
    firsts, a = (np.cumsum(sizes) - sizes)[order], None
    for t, n in enumerate(_live(sizes[order])):
        a = (a[:n] @ model.move if t else model.start[None, :]) * model.emit[classes[firsts[:n] + t]]
        s = a.sum(axis=1)
        a = a / s[:, None]
        total[order[:n]] += np.log10(s)
    return total


def _normal(start, move, emit) -> Hmm:
    start, move = start + 0.1, move + 0.1
    emit = emit + 1e-3 + 1e-3 * emit.sum(axis=1, keepdims=True) / emit.shape[1]
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _arrays(row: dict):
    return (np.frombuffer(row["held"], bool), np.frombuffer(row["sizes"], np.int64), np.frombuffer(unpack(row["tokens"]), np.uint32),
            np.frombuffer(row["words"], np.uint64), np.frombuffer(row["endings"], np.uint16), np.frombuffer(row["trained"], np.int64))


def _counts(batches):
    """The dictionary words of chunks with their training counts."""
    for batch in batches:
        for row in batch.to_pylist():
            words, endings, trained = (np.frombuffer(row[c], k) for c, k in (("words", np.uint64), ("endings", np.uint16), ("trained", np.int64)))
            seen = trained > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[seen].view(np.int64)), pa.array(endings[seen].astype(np.int32)), pa.array(trained[seen])],
                ["word", "ending", "n"])


def _wanted(batches):
    for batch in batches:
        for row in batch.to_pylist():
            words = np.frombuffer(row["words"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), row["chunk"])), pa.array(words)], ["chunk", "word"])


def train(packs: DataFrame, vocabulary: DataFrame, states: int = STATES, passes: int = PASSES) -> tuple[Hmm, Classes, np.ndarray]:
    """The model, its classes, and per class the mass of its words (count + 1 each, and 1 for unseen ones)."""
    spark = packs.sparkSession
    top = vocabulary.orderBy(F.desc("n"), "word").limit(TOP_WORDS).select("word", "n").collect()
    own = {np.int64(r.word).astype(np.uint64): r.n for r in top}
    classes = Classes(np.sort(np.array(list(own), np.uint64)))
    mass = np.ones(TOP_WORDS + ENDINGS)
    for i, word in enumerate(classes.top):
        mass[i] = own[word] + 1
    is_top = F.broadcast(spark.createDataFrame([(r.word,) for r in top], "word long"))
    rest = vocabulary.join(is_top, "word", "left_anti").groupBy("ending").agg(F.sum(F.col("n") + 1).alias("n")).collect()
    for r in rest:
        mass[TOP_WORDS + r.ending] += r.n
    size = TOP_WORDS + ENDINGS
    rng = np.random.default_rng(9)
    base = np.tile(mass[:, None], (1, states)) * rng.uniform(0.2, 1.8, (size, states))
    model = _normal(np.ones(states), np.ones((states, states)) + 20 * np.eye(states), base)

    # first values from one bounded sample
    number = packs.agg(F.min_by("chunk", F.xxhash64("chunk"))).first()[0]
    first = packs.select("held", "sizes", "tokens", "words", "endings", "trained").filter(F.col("chunk") == F.lit(number))
    for row in first.limit(1).collect():
        held, sizes, tokens, words, endings, _ = _arrays(row.asDict())
        keep = ~held
        keep[np.flatnonzero(keep)[FIRST_ROWS:]] = False
        of = classes.of(words, endings)[tokens]
        for _ in range(FIRST_PASSES if keep.any() else 0):
            model = _normal(*expected(model, of, sizes, keep)[:3])

    for _ in range(passes):
        shared = spark.sparkContext.broadcast((model, classes))

        def counted(batches):
            model, classes = shared.value
            total = None
            for batch in batches:
                for row in batch.to_pylist():
                    held, sizes, tokens, words, endings, _ = _arrays(row)
                    found = expected(model, classes.of(words, endings)[tokens], sizes, ~held)
                    total = found if total is None else [a + b for a, b in zip(total, found)]
            if total is not None:
                start, move, emit, _ = total
                used = np.flatnonzero(emit.sum(axis=1))
                rows = np.vstack([start, move, emit[used]])
                keys = np.concatenate([np.arange(-1 - len(start), 0), used])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), *[pa.array(rows[:, k]) for k in range(rows.shape[1])]], ["key", *[f"s{k}" for k in range(rows.shape[1])]])

        columns = [f"s{k}" for k in range(states)]
        parts = packs.select("held", "sizes", "tokens", "words", "endings", "trained").mapInArrow(
            counted, "key long, " + ", ".join(f"{c} double" for c in columns))
        summed = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in columns]).collect()
        if not summed:
            break
        values = np.zeros((1 + states + size, states))
        for r in summed:
            values[r.key + 1 + states] = r[1:]
        model = _normal(values[0], values[1:1 + states], values[1 + states:])
    return model, classes, mass


def score(docs: DataFrame, held_out: Column, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """Score every text; learn from those for which held_out is not true.

    Return doc_id, n_tokens, n_known, train_tokens, base_score and score (log10). Null and empty texts have one
    token, the end. Without training rows every token is unknown and the model is its first guess. Rows with equal
    ids are texts of their own.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    packs = written(chunks(docs, held_out), "lm-chunks")
    vocabulary = written(
        packs.select("words", "endings", "trained").mapInArrow(_counts, "word long, ending int, n long")
        .groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n")), "lm-vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model, classes, mass = train(packs, vocabulary, states, passes)
    shared = spark.sparkContext.broadcast((model, classes, mass))
    wanted = packs.select("chunk", "words").mapInArrow(_wanted, "chunk long, word long")
    known = wanted.join(vocabulary.select("word", "n"), "word")

    def scored(left, right):
        model, classes, mass = shared.value
        found = {c: right.column(c).to_numpy() for c in ("word", "n")}
        out = []
        for row in left.to_pylist():
            held, sizes, tokens, words, endings, _ = _arrays(row)
            n = np.zeros(len(words), np.int64)
            n[np.searchsorted(words, found["word"].view(np.uint64))] = found["n"]
            of = classes.of(words, endings)
            base = np.log10((n + 1) / (total + distinct + 1))
            within = np.log10(np.where(of < TOP_WORDS, 1.0, (n + 1) / mass[of]))
            first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            likely = forward(model, of[tokens], sizes)
            add = lambda values: np.add.reduceat(values[tokens], first) if len(first) else np.zeros(0)
            out.append(pa.table({
                "doc_id": pa.array(row["doc_ids"], left.schema.field("doc_ids").type.value_type), "n_tokens": pa.array(sizes),
                "n_known": pa.array(add((n > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(sizes), total)),
                "base_score": pa.array(add(base)), "score": pa.array(likely + add(within))}))
        return pa.concat_tables(out) if out else pa.table(
            {"doc_id": pa.array([], left.schema.field("doc_ids").type.value_type), "n_tokens": pa.array([], pa.int64()),
             "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()),
             "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})

    return packs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        scored, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Each operator against a plain computation, on the small documents table and on hard cases."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from urlvane.llm import byte_bpe, decontaminate, hmm, line_templates, near_duplicates, nearest, shared, suffix_dedup, token_counts
from urlvane.llm import queries as registered
from urlvane.llm.components import components

SF = "/root/testdata/sf0.001"
HARD = [
    None, "", " ", "\n\n", "a", "It's  the  end.\n\n  New line\t", "don'", "'re 're", "x" * 300, "Ünïcödé 漢字 😀 text ",
    "word " * 4000, "word " * 4000, "12345 67 8,9.0!!", "   wide spaces ", "A b C d e F g",
    "a B c D E f G", "tail of spaces" + " " * 5000 + "x", "é" * 2500,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(100_000 + i, t) for i, t in enumerate(HARD)]
    return rows


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(i, t, "junk") for i, t in docs], "doc_id long, text string, _at string").repartition(5).cache()


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("suffixes", [suffix_dedup.RANGE_SUFFIXES, 300])
def test_suffix_dedup(frame, docs, monkeypatch, suffixes):
    monkeypatch.setattr(suffix_dedup, "RANGE_SUFFIXES", suffixes)
    got = by_id(suffix_dedup.kept_bytes(frame))
    seen = {}
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        for i in range(len(data) - 49):
            seen.setdefault(data[i:i + 50], doc_id)
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, int)
        for i in range(len(data) - 49):
            if seen[data[i:i + 50]] < doc_id:
                gone[i:i + 50] = 1
        row = got[doc_id]
        spans = int((np.diff(np.append(0, gone)) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        assert (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) == (len(data), int(gone.sum()), spans, kept), doc_id


def test_suffix_merge_shares_prefixes():
    rng = np.random.default_rng(4)
    runs, all_rows = [], []
    for r in range(5):
        rows = sorted({bytes(x) for x in rng.integers(97, 99, (200, 6), dtype=np.uint8)})
        shared, rest = suffix_dedup.front_code(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 6))
        assert suffix_dedup.restore(shared, rest, 6) == rows
        runs.append((rows, shared.tolist(), [r * 1000 + i for i in range(len(rows))]))
        all_rows += [(s, r, i) for i, s in enumerate(rows)]
    expected = defaultdict(set)
    for s, r, i in all_rows:
        expected[s].add((r, i))
    got = [(runs[g[0][0]][0][g[0][1]], set(g), low) for g, low in suffix_dedup.merge_runs(runs)]
    assert [s for s, _, _ in got] == sorted(expected)
    assert all(members == expected[s] and low == min(r * 1000 + i for r, i in members) for s, members, low in got)


@pytest.fixture(scope="module")
def tiktoken_ids():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_byte_bpe(frame, docs, tiktoken_ids, monkeypatch):
    got = by_id(byte_bpe.round_trip(frame))
    for doc_id, text in docs:
        ids = tiktoken_ids(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    # small leaves put a cut at nearly every place
    monkeypatch.setattr(byte_bpe, "LEAF", 3)
    monkeypatch.setattr(byte_bpe, "WINDOW", 1)
    codec = byte_bpe.Codec(byte_bpe.RANKS)
    for _, text in docs[-len(HARD):] + docs[:60]:
        assert codec.encode((text or "")[:900]) == tiktoken_ids((text or "")[:900])


def test_byte_bpe_files(frame, docs):
    encoded = byte_bpe.encode(frame)
    assert {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(encoded).collect()} == {i: (t or "").encode() for i, t in docs}


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(frame, docs, tiktoken_ids, rule):
    got = defaultdict(list)
    for r in token_counts.section_counts(frame, rule).collect():
        got[r.doc_id].append(r)
    for doc_id, text in docs:
        rows = sorted(got[doc_id], key=lambda r: r.section)
        if not text:
            assert not rows
            continue
        assert sum(r.n_chars for r in rows) == len(text)
        ids = tiktoken_ids(text)
        assert sum(r.n_tokens for r in rows) == pytest.approx(len(ids))
        assert {r.text_tokens for r in rows} == {len(ids)}


def test_allocation_rules():
    starts, ends, bounds = np.array([0, 2, 6]), np.array([2, 6, 7]), np.array([0, 3, 7])
    rules = {"first": [2, 1], "last": [1, 2], "most": [1, 2], "split": [1.25, 1.75]}
    for rule, expected in rules.items():
        assert token_counts.allocate(starts, ends, bounds, rule).tolist() == expected


def shingle_set(text, n):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}


def plain_components(docs, n):
    sets = {i: shingle_set(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 10 * small >= 8 * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    p, q = sorted((find(a), find(b)))
                    parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, docs):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 50, 120)]
    near = []
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 120, 3):
            words[at] = f"x{rng.integers(0, 9)}"
        near.append((200_000 + i, " ".join(words)))
    rows = docs + near + [(300_000 + i, near[0][1].upper()) for i in range(30)]
    frame = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, key int")
    expected = plain_components(rows, 4)
    got = by_id(near_duplicates.near_duplicates(frame, words=4))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    kept = near_duplicates.keep_one_of_each(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in plain_components(rows, 5).items() if c == i}


def test_near_duplicates_odd_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(4, a, 1, 1), (7, a + " more", 1, 1), (7, b, 1, 1), (9, b, 1, 1), (None, b, 1, 1), (3, c, 1, 1), (3, c, 1, 1), (5, None, 1, 1), (5, "", 1, 1)]
    schema = "doc_id long, text string, gone int, component int"
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got if r.doc_id) == [
        (3, 3, True), (3, 3, True), (4, 4, True), (5, 5, True), (5, 5, True), (7, 4, False), (7, 4, False), (9, 4, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = near_duplicates.keep_one_of_each(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "gone", "component"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 3, 4, 5, 5]
    assert near_duplicates.keep_one_of_each(spark.createDataFrame([], schema)).count() == 0


def test_line_templates_odd_rows(spark):
    lines = [f"request {i} served by node n{i} today" for i in range(7)]
    rows = [(i, f"start {'xyz'[i % 3] * (i + 1)}\n{line}\nend {'pqr'[i % 3] * (i + 1)}", "a", "b", "c") for i, line in enumerate(lines)]
    schema = "doc_id long, text string, _gone string, _lines string, lines string"
    for extra in ([], [(None, "\n".join(lines), "a", "b", "c")], [(50, None, "a", "b", "c"), (51, "", "a", "b", "c")]):
        got = line_templates.drop_recurring(spark.createDataFrame(rows + extra, schema))
        assert got.columns == ["doc_id", "_gone", "_lines", "lines", "text", "n_lines", "n_dropped"]
        got = got.collect()
        assert len(got) == len(rows) + len(extra) and {(r._gone, r._lines, r.lines) for r in got} == {("a", "b", "c")}
        assert [(r.n_lines, r.n_dropped) for r in got if r.doc_id is not None and r.doc_id < 7] == [(3, 1)] * 7
        assert all(r.n_dropped == 0 for r in got if r.doc_id is None or r.doc_id >= 50)
    assert line_templates.drop_recurring(spark.createDataFrame([], schema)).count() == 0


def test_keep_clean(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "before " + item + " after", "l"), (2, item.replace("w7", "other"), "l"), (3, "plain words only", "l"), (None, item, "l"), (4, None, "l"), (5, "", "l")]
    schema = "doc_id long, text string, leak string"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.keep_clean(spark.createDataFrame(rows, schema), benchmark)
    assert kept.columns == ["doc_id", "text", "leak"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 4, 5]
    assert decontaminate.keep_clean(spark.createDataFrame([], schema), benchmark).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (120, 2))] + [(5, 5), (7, 6)]
    names = {}
    for a, b in edges:
        if a != b:
            names.setdefault(a, a), names.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and names[a] != names[b]:
                names[a] = names[b] = min(names[a], names[b])
                changed = True
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == names


def test_language_model(frame, docs):
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    got = by_id(hmm.score(frame, F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2"), states=4, passes=2))
    tokens = {i: re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in docs}
    counts = Counter(w for i, ws in tokens.items() if fold(i) != 2 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    better = 0
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in counts for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), rel=1e-9)
        better += r.score > r.base_score
    assert better > 0.9 * len(docs)


def test_forward_is_exact():
    rng = np.random.default_rng(2)
    model = hmm._normal(rng.random(3), rng.random((3, 3)), rng.random((5, 3)))
    classes, sizes = rng.integers(0, 5, 11), np.array([4, 1, 6])
    got = hmm.forward(model, classes, sizes)
    at = 0
    for size, value in zip(sizes, got):
        p = 0.0
        for path in np.ndindex(*[3] * size):
            q = model.start[path[0]]
            for t, s in enumerate(path):
                q *= model.emit[classes[at + t], s] * (model.move[path[t - 1], s] if t else 1)
            p += q
        assert value == pytest.approx(math.log10(p))
        at += size


def test_baum_welch_improves():
    rng = np.random.default_rng(5)
    classes = np.concatenate([rng.integers(0, 10, 300), rng.integers(10, 20, 300)])
    sizes = np.full(30, 20)
    model = hmm._normal(np.ones(2), np.ones((2, 2)), rng.random((20, 2)) + 0.5)
    likes = []
    for _ in range(60):
        start, move, emit, like = hmm.expected(model, classes, sizes, np.ones(30, bool))
        likes.append(like)
        assert emit.sum() == pytest.approx(600) and move.sum() == pytest.approx(570) and start.sum() == pytest.approx(30)
        model = hmm._normal(start, move, emit)
    assert likes[-1] > likes[0] + 50


def vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=12))]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]
    rows += [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [None] + [1.0] * 11), (2100, [float("inf")] * 12), (2200, [1.0])]
    return rows, spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, leaf int")


def test_nearest(spark):
    rows, frame = vectors(spark)
    good = [(i, np.array(v)) for i, v in rows if i < 2000]
    ids, points = np.array([i for i, _ in good]), np.array([v for _, v in good])
    got = defaultdict(list)
    for r in nearest.search(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    found = 0
    for q, own in got.items():
        far = np.sqrt(((points - points[ids == q][0]) ** 2).sum(1))
        best = [(far[k], ids[k]) for k in np.lexsort((ids, far)) if ids[k] != q][:10]
        assert [r.rank for r in own] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        assert all(r.score == pytest.approx(float(far[ids == r.vec_id][0]), rel=1e-12) for r in own)
        found += len({r.vec_id for r in own} & {int(i) for _, i in best})
    assert found >= 0.9 * 10 * len(got)


def test_nearest_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], schema)
    got = nearest.search(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 2)]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in registered.op1_language_id(spark, sf).collect() if r.held_out]
    assert len(got) > 100 and np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.95
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in registered.op6_toxicity(spark, sf).collect() if r.held_out and toxic.get(r.doc_id) is not None]
    assert np.mean([toxic[r.doc_id] == r.predicted for r in got]) > 0.93
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_cuts_change_no_count(monkeypatch, piece):
    rng = np.random.default_rng(1)
    model = hmm._normal(rng.random(3), rng.random((3, 3)), rng.random((20, 3)) + 0.1)
    sizes = rng.integers(1, 40, 30)
    sizes[3] = 200
    classes, keep = rng.integers(0, 20, sizes.sum()), rng.random(30) > 0.2
    monkeypatch.setattr(hmm, "PIECE", 1_000)
    whole = hmm.expected(model, classes, sizes, keep)
    assert whole[3] == pytest.approx(hmm.forward(model, classes, sizes)[keep].sum())
    monkeypatch.setattr(hmm, "PIECE", piece)
    monkeypatch.setattr(hmm, "STEP_TOKENS", 50)
    for a, b in zip(whole, hmm.expected(model, classes, sizes, keep)):
        assert np.allclose(a, b)


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """Many edits of one text: all links found, though few pairs are compared and most lie just under the threshold."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(240):
        source = rng.choice(texts).split() if i % 8 == 7 else base
        edited = list(source)
        for at in rng.sample(range(150), rng.choice([1, 4, 6, 7]) if source is base else 2):
            edited[at] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(edited))
    tested = []
    plain = near_duplicates.written

    def counted(df, name):
        table = plain(df, name)
        tested.extend([table.count()] * (name == "pairs"))
        return table

    monkeypatch.setattr(near_duplicates, "written", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(frame, words=4).collect()}
    sets = [{tuple(w[i:i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    component = list(range(len(sets)))
    for y in range(len(sets)):
        for x in range(y):
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) and component[x] != component[y]:
                low, high = sorted((component[x], component[y]))
                component = [low if c == high else c for c in component]
    assert [got[i] for i in range(len(texts))] == component
    assert 1 < len(set(component)) < len(texts) and tested[-1] < 5 * len(texts)


def test_written_leaves_no_shuffle_files(spark):
    """The pipeline's near_dedup filled the disk with the shuffle files of its many rounds."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f.name for folder in folders for f in Path(folder.getPath()).glob("*/shuffle_*.data")}
    before, name = files(), spark.conf.get(shared.CLEANUP)
    table = shared.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(shared.CLEANUP) == name
    assert {r.k: r["count"] for r in table.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}


@pytest.mark.parametrize("signs, block", [(2, 7), (2, 1 << 15), (200, 16)])
def test_anchors_and_repeated_grams(monkeypatch, signs, block):
    """Against plain loops: each window's anchor, and the places of grams that two texts hold."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = np.random.default_rng(signs)
    texts = [bytes(rng.integers(33, 33 + signs, n, dtype=np.uint8)) for n in (0, 9, 10, 40, 3, 25)]
    texts += [texts[3][5:30] + texts[5], texts[3]]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    length, gram = 10, 6
    hashes = suffix_dedup.gram_hashes(data, gram)
    places, found, rows, own = suffix_dedup.anchors(data, offsets, length, gram)
    drop = np.uint64(7)
    expected = np.full(len(data), -1)
    for a, b in zip(offsets, offsets[1:]):
        for i in range(a, b - length + 1):
            expected[i] = min(range(i, i + length - gram + 1), key=lambda j: (hashes[j] & ~drop, j))
    assert own.tolist() == expected.tolist()
    assert places.tolist() == sorted(set(expected.tolist()) - {-1})
    assert found.tolist() == hashes[places].tolist()
    assert all(offsets[r] <= p < offsets[r + 1] for p, r in zip(places, rows))
    frame = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array([x.decode("latin-1") for x in texts])})
    if signs == 2:  # one byte a sign
        blobs = pa.Table.from_batches(list(suffix_dedup._anchor_blobs(length, gram, 1)(iter([frame]))))
        got = {r["doc_id"]: sorted(r["places"]) for r in suffix_dedup._repeated(blobs).to_pylist()}
        holders = {}
        for p, r in zip(places, rows):
            if r != 7:  # a copy adds nothing
                holders.setdefault(bytes(data[p:p + gram]), set()).add(r)
        want = {}
        for p, r in zip(places, rows):
            if r != 7 and len(holders[bytes(data[p:p + gram])]) > 1:
                want.setdefault(int(r), []).append(int(p - offsets[r]))
        assert got == want and got


def test_suffix_merge_of_empty_runs():
    assert list(suffix_dedup.merge_runs([])) == list(suffix_dedup.merge_runs([([], [], [])] * 3)) == []
    runs = [([], [], []), ([b"aa", b"ab"], [0, 1], [5, 6]), ([b"aa"], [0], [3])]
    assert [(sorted(g), low) for g, low in suffix_dedup.merge_runs(runs)] == [([(1, 0), (2, 0)], 3), ([(1, 1)], 6)]


def test_anchors_in_many_buckets_stay_small(monkeypatch):
    """Dealt out to twenty times the buckets, anchors take less than twice the bytes, and the same grams are repeated."""
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(97, 123, 3000))) for _ in range(700)]
    texts[9] = texts[3][:1000] + texts[9][1000:]
    frame = pa.record_batch({"doc_id": pa.array(range(700), pa.int64()), "text": pa.array(texts)})

    def dealt(buckets):
        return [b for b in suffix_dedup._anchor_blobs(50, 34, buckets)(iter([frame])) if b.num_rows]

    def size(batches):
        return sum(len(x) for b in batches for name in b.schema.names if name != "bucket" for x in b.column(name).to_pylist())

    few, many = dealt(50), dealt(1000)
    assert size(many) < 2 * size(few)

    def places(batches):
        table, out = pa.Table.from_batches(batches), set()
        for b in set(table.column("bucket").to_pylist()):
            found = suffix_dedup._repeated(table.filter(pa.compute.equal(table.column("bucket"), b)))
            out |= {(r["doc_id"], p) for r in found.to_pylist() for p in r["places"]}
        return out

    assert places(few) == places(many) and {d for d, _ in places(few)} == {3, 9}
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 1)
    assert places(dealt(50)) == places(few)


def test_suffix_dedup_merges_in_passes(frame, monkeypatch):
    """The passes that share out the ranges find the same, and leave no tables behind but digests, copies, repeated suffixes and spans."""
    want = by_id(suffix_dedup.kept_bytes(frame))
    made, gone = [], []
    monkeypatch.setattr(suffix_dedup, "RANGE_SUFFIXES", 20)
    monkeypatch.setattr(suffix_dedup, "PASS_RANGES", 2)
    write, discard = suffix_dedup.written, suffix_dedup.discard
    monkeypatch.setattr(suffix_dedup, "written", lambda df, name: made.append(name) or write(df, name))
    monkeypatch.setattr(suffix_dedup, "discard", lambda *tables: gone.extend(tables) or discard(*tables))
    assert by_id(suffix_dedup.kept_bytes(frame)) == want
    assert max(made.count("smallest-ids"), made.count("later-suffixes")) > 2
    assert len(made) - len(gone) == made.count("repeated-suffixes") + 3

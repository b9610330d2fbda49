"""MinHash near-duplicates with tensored banding.

Two small collections of minhash groups are computed for each text; every pair of a group of the
first and a group of the second is a table key. A x B keys thus cost only A + B groups of minhashes,
about the square root of what as many independent keys would. Texts with equal shingle sets are one
class; texts that share a key are candidates and are confirmed on their full sets.

Pairs are taken from a key only if their sizes leave room for the similarity and if a sketch of one bit
per minhash does not rule it out. Nobody is compared with everybody: in each round a text is compared
with single members of a few of its keys. Rounds go on while they find many links. What is then still apart is told apart by
how it differs from its group (see `_apart`), so no link that matters to a component is lost and a large group
of texts near the threshold is not compared all with all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from urlvane.llm.components import components
from urlvane.llm.shared import blob, discard, fresh, in_slices, mix, written
from urlvane.llm.words import Words, distinct_per_row

#: Groups in each collection, and minhashes in a group. At a similarity of 0.8 a pair shares no key with a
#: probability of about 2 * (1 - 0.8 ** 3) ** 14, or 0.00009.
GROUPS = 14
ROWS = 3
#: Bits of the sketch, one from each minhash (those of the groups first).
BITS = 128
#: Members that a text is compared with in a round, at most.
HUBS = 4
#: A round that links less than this share of the texts still open is the last but the full one.
PROGRESS = 0.05


def _signatures(words: int):
    rng = np.random.default_rng(7)
    salts = rng.integers(0, 1 << 63, BITS, dtype=np.uint64)
    odd = rng.integers(0, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    grouped = 2 * GROUPS * ROWS

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        values, first = distinct_per_row(*Words(part.column("text")).shingles(words), n)
        sizes = np.diff(first)
        full = np.flatnonzero(sizes)
        low = np.zeros((n, BITS), np.uint64)
        sums = np.zeros((n, 2), np.uint64)
        if len(full):
            for i in range(BITS):
                low[full, i] = np.minimum.reduceat((values ^ salts[i]) * odd[i], first[full])
            sums[full, 0] = np.add.reduceat(mix(values), first[full])
            sums[full, 1] = np.add.reduceat(mix(values + np.uint64(77)), first[full])
        groups = low[:, :grouped].reshape(n, 2, GROUPS, ROWS)
        keys = np.zeros((n, 2, GROUPS), np.uint64)
        for r in range(ROWS):
            keys = mix(keys + groups[..., r] + np.arange(2 * GROUPS, dtype=np.uint64).reshape(2, GROUPS))
        bits = np.packbits((mix(low) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
        lists = lambda side: pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1, dtype=np.int32) * GROUPS), pa.array(np.ascontiguousarray(keys[:, side]).ravel().view(np.int64)))
        longs = lambda column: pa.array(np.ascontiguousarray(column).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(sizes), longs(sums[:, 0]), longs(sums[:, 1]), lists(0), lists(1), longs(bits[:, 0]), longs(bits[:, 1])],
            ["doc_id", "n_shingles", "set_a", "set_b", "left", "right", "bits_a", "bits_b"])

    return in_slices(run)


def _sets(words: int):
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        values, first = distinct_per_row(*Words(part.column("text")).shingles(words), part.num_rows)
        parts = [values[a:b] for a, b in zip(first, first[1:])]
        total = lambda salt: pa.array(np.array([mix(p + np.uint64(salt)).sum(dtype=np.uint64) for p in parts], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), total(0), total(77), pa.array([blob(p) for p in parts], pa.binary())],
            ["head", "set_a", "set_b", "shingles"])

    return in_slices(run)


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(a, b)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _may_link(a: str, b: str, percent: int) -> Column:
    """The sizes leave room for the similarity, and the sketches differ in no more bits than it allows.

    At the similarity itself a sketch differs in BITS * (1 - similarity) / 2 bits; the limit lies six standard deviations above.
    """
    differ = (1 - percent / 100) / 2
    limit = math.ceil(BITS * differ + 6 * math.sqrt(BITS * differ * (1 - differ)))
    value = lambda side, name: F.col(f"{side}.{name}")
    sizes = 100 * F.least(value(a, "n_shingles"), value(b, "n_shingles")) >= percent * F.greatest(value(a, "n_shingles"), value(b, "n_shingles"))
    return sizes & (sum(F.bit_count(value(a, c).bitwiseXOR(value(b, c))) for c in ("bits_a", "bits_b")) <= limit)


def _members(heads: DataFrame) -> DataFrame:
    """node, n_shingles, bits and key of texts that share the key; only groups that two texts have are paired to keys."""
    groups = heads.select("node", F.explode(F.concat("left", "right")).alias("group"))
    common = groups.groupBy("group").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("group")
    held = groups.join(common, "group", "left_semi").groupBy("node").agg(F.collect_set("group").alias("held"))
    both = heads.join(held, "node")
    pairs = F.flatten(F.transform(F.array_intersect("left", "held"), lambda x: F.transform(
        F.array_intersect("right", "held"), lambda y: F.xxhash64(x, y))))
    keys = written(both.select("node", "n_shingles", "bits_a", "bits_b", F.explode(pairs).alias("key")).dropDuplicates(["node", "key"]), "keys")
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    members = written(keys.join(shared, "key", "left_semi"), "members")
    discard(keys)
    return members


def _items():
    """Rows group and item: every shingle of every text."""
    def run(batches):
        for batch in batches:
            held = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
            groups = np.repeat(batch.column("group").to_numpy(), [len(x) for x in held])
            yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array(np.concatenate(held) if held else np.zeros(0, np.int64))], ["group", "item"])

    return run


def _differences():
    """The text's shingles that are not usual in its group, and the usual ones that it lacks."""
    def run(batches):
        for batch in batches:
            usual = batch.column("usual")
            parts = [np.setxor1d(np.frombuffer(x, np.int64), np.array(u or [], np.int64))
                     for x, u in zip(batch.column("shingles").to_pylist(), usual.to_pylist())]
            sizes = np.array([len(x) for x in parts], np.int64)
            items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                             pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
            kept = ["group", "node", "component", "n_shingles"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sizes), items], [*kept, "size", "items"])

    return run


def _apart(still: DataFrame, shingles: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs a, b among which are links enough to join all components that links between texts of a key join, and scratch tables.

    Texts that keys connect are a group, and the shingles that more than half of it have are its usual ones. D(x) is what x differs
    in from those, so x and y differ in what D(x) and D(y) do not share. With p percent they are linked if they differ in at most
    (100 - p) / (100 + p) * (|x| + |y|) shingles. Let S(x) = (100 + p) |D(x)| - (100 - p) |x|.

    * If S(x) + S(y) <= 0 they are linked whatever they share. Both are then linked with the text of least S, too:
      one pair for each text on this side of it says all.
    * Else they must share at least (S(x) + S(y)) / (2 (100 + p)) of their differences. The first one they share, the rarest
      coming first, leaves that many in both. Differences that only one text has are no first one; as they come first, little
      of what many texts share is left to look at.
    """
    low = still.groupBy("key").agg(F.min("node").alias("b"))
    groups = components(still.select("key", "node").join(low, "key").select(F.col("node").alias("a"), "b"))
    open_texts = still.select("node", "n_shingles", "component").distinct()
    texts = written(open_texts.join(groups.select(F.col("id").alias("node"), F.col("component").alias("group")), "node").join(shingles, "node"), "grouped")
    sizes = texts.groupBy("group").agg(F.count("*").alias("texts"))
    counts = texts.select("group", "shingles").mapInArrow(_items(), "group long, item long").groupBy("group", "item").agg(F.count("*").alias("n"))
    # at most twice the mean number of shingles of the group's texts
    usual = counts.join(sizes, "group").filter("2 * n > texts").groupBy("group").agg(F.collect_list("item").alias("usual"))
    found = written(texts.join(usual, "group", "left").mapInArrow(
        _differences(), "group long, node long, component long, n_shingles long, size long, items array<long>"), "differences")
    up, down = 100 + percent, 100 - percent
    placed = found.select("group", "node", "component", "n_shingles", "size", (up * F.col("size") - down * F.col("n_shingles")).alias("s"))
    best = placed.groupBy("group").agg(F.min(F.struct("s", "node", "component")).alias("best"))
    placed = placed.join(best, "group")
    near = placed.filter((F.col("s") + F.col("best.s") <= 0) & (F.col("component") != F.col("best.component"))).select(
        F.least("node", "best.node").alias("a"), F.greatest("node", "best.node").alias("b"))
    each = found.select("group", "node", F.explode("items").alias("item"))
    shared = each.groupBy("group", "item").agg(F.count("*").alias("n")).filter("n > 1")
    ranks = each.join(shared, ["group", "item"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("ranked"))
    ranked = placed.join(ranks, "node").select(
        "group", "node", "component", "n_shingles", "s", F.col("best.s").alias("least"), (F.size("ranked")).alias("common"), F.posexplode("ranked").alias("at", "one"))
    # how many differences come from this one on; those of one text only come before all
    ranked = written(ranked.select("group", F.col("one.item").alias("item"), "node", "component", "n_shingles", "s", "least",
                                   (F.col("common") - F.col("at")).alias("left")).join(
        found.select("node", "size"), "node"), "ranked")
    value = F.struct("node", "component", "n_shingles", "s", "left")
    own = ranked.filter(2 * up * F.col("left") > F.col("s") - F.col("least")).select("group", "item", value.alias("own"))
    other = ranked.filter((F.col("s") + F.col("least") > 0) & (percent * (F.col("size") - F.col("left")) <= down * F.col("n_shingles"))).select(
        "group", "item", value.alias("other"))
    pairs = own.join(other, ["group", "item"]).filter(
        (F.col("own.component") != F.col("other.component"))
        & (2 * up * F.least("own.left", "other.left") >= F.col("own.s") + F.col("other.s"))
        & (100 * F.least("own.n_shingles", "other.n_shingles") >= percent * F.greatest("own.n_shingles", "other.n_shingles")))
    pairs = pairs.select(F.least("own.node", "other.node").alias("a"), F.greatest("own.node", "other.node").alias("b"))
    return pairs.union(near).distinct(), [texts, found, ranked]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Return doc_id, n_shingles, component_id and kept for every row of doc_id (whole number) and text.

    Texts are linked if 100 * intersection >= percent * union of their sets of word shingles (A-Z lowered; a text with
    fewer words is one shingle). A component is named by its smallest id, and that document is kept. Null and empty texts and
    those without words are linked with nothing. Rows with equal ids are one document: the texts of all of them link it,
    but a row without words stands alone. A row with a null id stands alone, has no component and is kept. An empty table
    gives no rows. Other columns of docs take no part.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(texts.mapInArrow(
        _signatures(words), "doc_id long, n_shingles long, set_a long, set_b long, left array<long>, right array<long>, bits_a long, bits_b long"),
        "signatures")
    sets = ["n_shingles", "set_a", "set_b"]
    full = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # texts with equal sets are one node
    classes = written(full.groupBy(*sets).agg(F.min("doc_id").alias("head")).withColumn("node", F.monotonically_increasing_id()), "classes")
    heads = full.withColumnRenamed("doc_id", "head").join(classes, ["head", *sets]).dropDuplicates(["node"])
    members = _members(written(heads.select("node", "n_shingles", "bits_a", "bits_b", "left", "right"), "heads"))
    candidates = classes.join(members.select("node").distinct(), "node", "left_semi")
    wanted = texts.withColumnRenamed("doc_id", "head").join(candidates.select("head").distinct(), "head", "left_semi")
    shingles = wanted.withColumnRenamed("head", "doc_id").mapInArrow(_sets(words), "head long, set_a long, set_b long, shingles binary")
    shingles = written(shingles.join(candidates.drop("n_shingles"), ["head", "set_a", "set_b"]).select("node", "shingles").dropDuplicates(["node"]), "shingles")

    def confirmed(pairs):
        left = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        right = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_confirmed(percent), "a long, b long")

    # an id with several texts ties their nodes together
    ids = full.select("doc_id", *sets).join(classes, sets).select("doc_id", "node")
    several = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("high")).filter("a < high").select("doc_id", "a")
    links = written(ids.join(several, "doc_id").select("a", F.col("node").alias("b")).filter("a < b").distinct(), "links")
    found = components(links)
    turn, stars, scratch = 0, True, []
    while True:
        named = members.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
        still = written(named.join(mixed.select("key"), "key", "left_semi"), "open")
        own = still.select("key", F.struct("node", "n_shingles", "bits_a", "bits_b", "component").alias("own"))
        if stars:
            # one member per key, another each round, and a few such members for each text
            order = F.xxhash64("node", F.lit(turn)) if turn else F.lit(0).cast("long")
            hub = still.groupBy("key").agg(F.min(F.struct(order.alias("order"), "node", "n_shingles", "bits_a", "bits_b", "component")).alias("other"))
            pairs = own.join(hub, "key").filter((F.col("own.component") != F.col("other.component")) & _may_link("own", "other", percent))
            pairs = pairs.groupBy(F.col("own.node").alias("node"), F.pmod(F.xxhash64("other.node"), F.lit(HUBS))).agg(F.min(F.struct("other.order", "other.node")).alias("other"))
            pairs = pairs.select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b")).distinct()
        else:
            pairs, used = _apart(still, shingles, percent)
            scratch += used
        pairs = written(pairs, "pairs")
        new = written(confirmed(pairs), "links")
        count = new.count()
        if count:
            scratch.append(links)
            links = written(links.union(new), "links")
            found = components(links)
        if not stars:
            break
        stars, turn = count >= PROGRESS * still.select("node").distinct().count() and count > 0, turn + 1
        discard(still, pairs, new)
    discard(members, shingles, still, pairs, new, *scratch)
    tied = classes.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = tied.groupBy("component").agg(F.min("head").alias("component_id"))
    named = tied.join(least, "component").select(*sets, "component_id")
    # a null size joins with no class
    result = rows.withColumn("n", F.col("n_shingles")).withColumn("n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("n"))).join(named, sets, "left")
    component = F.coalesce("component_id", "doc_id")
    return result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Drop all but the smallest id of each group of near-duplicates; columns stay as they are, whatever their names.

    Of rows with equal ids all stay or go together. Rows with a null id stay. An empty table stays empty.
    """
    gone = fresh(docs, "gone")
    found = near_duplicates(docs)
    lost = found.groupBy(F.col("doc_id").alias(gone)).agg(F.min("kept").alias("kept")).filter("NOT kept").select(gone)
    return docs.join(lost, docs["doc_id"] == F.col(gone), "left_anti")

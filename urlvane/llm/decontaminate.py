"""Benchmark decontamination with spaced seeds, on built-in DataFrame functions only.

A seed hashes the words at the ones of a fixed mask and ignores those at its zeros, so substituted
words between them do not matter. Seeds of texts and of benchmark items are joined; each hit
names one alignment of item and text, whose words are then compared one by one. Texts are cut into
letters and digits, in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from urlvane.llm.shared import fresh, written

#: Word positions that a seed looks at: items of eight words or more, in which the stated part agrees, share one of the
#: first three with the text; items of five to seven words one of the next four; shorter ones must agree in all words.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 6, 7))
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
WHOLE_MASKS = ((0,), (0, 1), (0, 1, 2), (0, 1, 2, 3))
ALL_MASKS = MASKS + SHORT_MASKS + WHOLE_MASKS
#: Compared words: the whole item, or a stretch of so many of it.
STRETCH = 13
SIMILARITY = 0.8
#: Seeds that are broadcast at once (rows of four numbers, some 50 MB); more of them are taken in blocks.
SEEDS_AT_ONCE = 1_000_000


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def _hashed(text: str) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _seeded(df: DataFrame, keep: list[str], numbers: list[int], fits=lambda number: F.lit(True)) -> DataFrame:
    """One row per position and mask that lies in the words, as _w, _at and _seed; fits names masks by the words' number."""
    places = df.filter(F.size("words") > 0).select(
        *keep, F.col("words").alias("_w"), F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("_at"))
    seed = lambda number, mask: F.when(
        fits(number) & (F.col("_at") + mask[-1] < F.size("_w")),
        F.xxhash64(F.lit(number), *[F.get(F.col("_w"), F.col("_at") + i) for i in mask]))
    seeds = F.array(*[seed(n, ALL_MASKS[n]) for n in numbers])
    return places.select(*keep, "_w", "_at", F.posexplode(seeds).alias("_mask", "_seed")).filter("_seed IS NOT NULL")


def _for_items(number: int) -> Column:
    """Whether items of these words use the mask."""
    size = F.size("_w")
    if number < len(MASKS):
        return size >= 8
    return size.between(5, 7) if number < len(MASKS + SHORT_MASKS) else size == len(ALL_MASKS[number])


def _hits(texts: DataFrame, seeds: DataFrame, masks: list[int], blocks: int) -> DataFrame:
    """Alignments of texts and items: the text's words from where the item would begin, `skip` item words left of the text."""
    found = None
    for block in range(blocks):
        some = seeds.filter(F.pmod("seed", F.lit(blocks)) == block) if blocks > 1 else seeds
        hits = _seeded(texts, ["doc_id", "_text"], masks).join(F.broadcast(some), F.col("_seed") == F.col("seed")).select(
            "doc_id", "_text", "item", (F.col("_at") - F.col("item_at")).alias("shift"),
            F.greatest(F.col("item_at") - F.col("_at"), F.lit(0)).alias("skip"),
            F.slice("_w", F.greatest(F.col("_at") - F.col("item_at"), F.lit(0)) + 1, F.col("size")).alias("text_words"))
        found = hits if found is None else found.unionByName(hits)
    return found.dropDuplicates(["doc_id", "_text", "item", "shift"])


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, stretch: int = STRETCH) -> DataFrame:
    """Return doc_id, item_id, item_words, stretch_words, matched and similarity: one row per text and item it holds.

    A text holds an item if at some alignment a stretch of min(item words, `stretch`) words agrees in at least
    `similarity` of them; the row gives the best stretch. All are found for a similarity of 0.8 or more and the stated
    stretch where that stretch is the whole item; in longer items, stretches that share a seed. Items of one to four words must
    agree in all words. Null and empty texts and items hold nothing. Rows with equal ids are looked at one by one and
    give the best result of each pair of ids; null ids are ids like others. Empty tables give no rows; columns other than id and
    text are not read.
    """
    key = F.xxhash64("item_id", "words").alias("item")
    items = benchmark.select("item_id", _hashed("text").alias("words")).filter("words IS NOT NULL")
    items = items.select(key, "item_id", "words").dropDuplicates(["item"])
    seeds = written(_seeded(items, ["item"], list(range(len(ALL_MASKS))), _for_items).select(
        F.col("_seed").alias("seed"), "item", F.col("_at").alias("item_at"), F.size("_w").alias("size"), "_mask").distinct(), "seeds")
    masks = {r["_mask"]: r["count"] for r in seeds.groupBy("_mask").count().collect()}
    blocks = -(-sum(masks.values()) // SEEDS_AT_ONCE)
    texts = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("_text"), _hashed("text").alias("words")).filter("words IS NOT NULL")
    hits = _hits(texts, seeds.drop("_mask"), sorted(masks) or [0], max(blocks, 1))
    hits = hits.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    length = F.least(F.size("item_words"), F.lit(stretch))
    agree = F.transform("item_words", lambda w, i: F.when(
        (i >= F.col("skip")) & (w == F.get(F.col("text_words"), i - F.col("skip"))), 1).otherwise(0))
    hits = hits.select("doc_id", "item_id", F.size("item_words").alias("item_words"), length.alias("stretch_words"), agree.alias("agree"))
    # running sums give the matches of each stretch
    sums = F.aggregate("agree", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    best = F.array_max(F.transform(
        F.sequence(F.lit(0), F.col("item_words") - F.col("stretch_words")),
        lambda i: F.get(F.col("sums"), i + F.col("stretch_words")) - F.get(F.col("sums"), i)))
    measured = hits.withColumn("sums", sums).select("doc_id", "item_id", "item_words", "stretch_words", best.alias("matched"))
    top = measured.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("matched", "stretch_words", "item_words")).alias("top")).select("doc_id", "item_id", "top.*")
    return top.withColumn("similarity", F.col("matched") / F.col("stretch_words")).filter(F.col("similarity") >= similarity).select(
        "doc_id", "item_id", "item_words", "stretch_words", "matched", "similarity")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Drop documents that hold a benchmark item; columns stay as they are, whatever their names.

    Of rows with equal ids all stay or go together; rows with a null id stay. An empty table stays empty.
    """
    leak = fresh(docs, "leak")
    found = leaks(docs, benchmark).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(found, docs["doc_id"] == F.col(leak), "left_anti")

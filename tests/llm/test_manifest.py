"""The manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from urlvane.llm import manifest, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """Root, and per node the (left, right) siblings of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            first = a // 16 * 16
            paths[i].append((nodes[first:a], nodes[a + 1:first + 16]))
        nodes = [sha(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
        at = [a // 16 for a in at]
    return nodes[0], paths


def plain(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    root, above = tree([tops[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        subroot, paths = tops[s]
        for (_, _, own, row), path in zip(sorted(sources[s], key=lambda x: x[:3]), paths):
            path = path + up
            low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            node = leaf((*row[:4], low(row[4]))) if zlib.crc32(str("" if row[0] is None else row[0]).encode()) % 5 == 0 else own
            for left, right in path:
                node = sha(*left, node, *right)
            out.append((row[0], own, subroot, root, sha(*[d for left, right in path for d in left + right]), node, node == root))
    return sorted(out, key=str)


def made_up(seed, size, sources):
    dice = random.Random(seed)
    names = [f"s{i}é" for i in range(sources)] + [None, ""]
    return [(i, names[0] if dice.random() < 0.33 else dice.choice(names), dice.choice(["en", None]), dice.choice([None, 7]),
             dice.choice([None, "", "No Upper?", "ÄÖ lower", "X" * 1000]) ) for i in range(size)]


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, queries.op13_manifest(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_rows_are_those_of_a_plain_tree(spark, tmp_path, monkeypatch, digits):
    monkeypatch.setattr(manifest, "DIGITS", digits)
    rows = made_up(1, 900, 30)
    assert run(spark, tmp_path, rows) == plain(rows)


@pytest.mark.parametrize("size, sources", [(1, 1), (16, 1), (17, 1), (40, 300)])
def test_small_tables(spark, tmp_path, size, sources):
    rows = made_up(size, size, sources)
    assert run(spark, tmp_path, rows) == plain(rows)


def test_equal_and_null_ids(spark, tmp_path):
    rows = [(1, "a", None, 1, "T"), (1, "a", None, 1, "T"), (1, "a", None, 1, "U"), (None, "a", "x", None, None), (None, None, None, None, None)]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_tampering_is_found(spark, tmp_path):
    rows = [(i, "a", "en", 3, "Abc" if i % 2 else "abc") for i in range(200)]
    for doc_id, *_, verified in run(spark, tmp_path, rows):
        assert verified == (zlib.crc32(str(doc_id).encode()) % 5 != 0 or doc_id % 2 == 0)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert manifest.checked(manifest.manifest(docs, FIELDS)).count() == 0
    docs = spark.createDataFrame([(1, "a", "b", 2, "c")], SCHEMA).withColumns(
        {c: F.lit("x") for c in ("node", "idx", "n", "kids", "path", "top", "part", "at", "all", "block", "d0", "root")})
    row = manifest.checked(manifest.manifest(docs, FIELDS)).first()
    assert row.leaf == row.root == leaf((1, "a", "b", 2, "c")) and row.verified and row.proof_sha256 == sha()

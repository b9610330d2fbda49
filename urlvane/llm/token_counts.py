"""Token counts of sections, from one encoding of the whole text.

Each text is encoded once. Tokens and sections are both spans of characters of the text; joining
the spans (both sorted, so by binary search) gives every section its tokens. A token that crosses a
boundary is allocated by a rule:

* `first`: to the section that holds its first character (the default, counts add up to the text's),
* `last`: to the section that holds its last character,
* `most`: to the section that holds most of its characters, the earlier one if equal,
* `split`: to all of them, by their share of its characters.

A token that holds only a part of a character belongs where that character is.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from urlvane.llm.byte_bpe import RANKS, codec
from urlvane.llm.shared import in_slices

RULES = ("first", "last", "most", "split")
#: A section is a line with its line feed.
SECTION = r"[^\n]*\n|[^\n]+\Z"


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section; tokens are [start, end) and sections [bounds[i], bounds[i+1]), without gaps."""
    sections = len(bounds) - 1
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    if rule == "first":
        return np.bincount(first, minlength=sections).astype(float)
    if rule == "last":
        return np.bincount(last, minlength=sections).astype(float)
    counts = np.bincount(first[first == last], minlength=sections).astype(float)
    for i in np.flatnonzero(first != last):
        own = np.arange(first[i], last[i] + 1)
        share = np.minimum(bounds[own + 1], ends[i]) - np.maximum(bounds[own], starts[i])
        if rule == "most":
            counts[own[share.argmax()]] += 1
        else:
            counts[own] += share / (ends[i] - starts[i])
    return counts


def section_counts(docs: DataFrame, rule: str = "first", pattern: str = SECTION, path: str = RANKS,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, section (from 0), first_char, n_chars, n_tokens and text_tokens, one row per section of every text.

    The pattern's matches must follow each other without gaps. Null and empty texts have no section and no row.
    Characters are code points.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        c, cut = codec(path), re.compile(pattern)
        ids_col = part.column("doc_id")
        rows, section, first, size, counts, whole = [], [], [], [], [], []
        for row, value in enumerate(part.column("text").to_pylist()):
            if not value:
                continue
            ids = np.array(c.encode(value), np.int64)
            ends_b = np.cumsum(c.lengths[ids])
            data = np.frombuffer(value.encode(), np.uint8)
            # the character each byte belongs to
            char = np.cumsum((data & 0xC0) != 0x80) - 1
            starts, ends = char[ends_b - c.lengths[ids]], char[ends_b - 1] + 1
            bounds = np.array([0, *(m.end() for m in cut.finditer(value))], np.int64)
            n = len(bounds) - 1
            rows.append(np.full(n, row))
            section.append(np.arange(n))
            first.append(bounds[:-1])
            size.append(np.diff(bounds))
            counts.append(allocate(starts, ends, bounds, rule))
            whole.append(np.full(n, len(ids)))
        join = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
        return pa.RecordBatch.from_arrays(
            [ids_col.take(join(rows, np.int64)), join(section, np.int64), join(first, np.int64), join(size, np.int64),
             join(counts, float), join(whole, np.int64)],
            ["doc_id", "section", "first_char", "n_chars", "n_tokens", "text_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        in_slices(run),
        f"doc_id {kind}, section long, first_char long, n_chars long, n_tokens double, text_tokens long")

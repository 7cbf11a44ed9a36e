"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words joined by single spaces; the automaton holds every window of `words` consecutive words of
every item (an item of fewer words, but not none, is one window), padded by spaces so that matches fall on word borders.
One scan of a text gives all occurrences; they are kept as word ranges and mapped back to code points of the original.

An automaton has at most about BLOCK_NODES nodes (one for each character of a window's text at most; a node takes some 40 bytes in each
Python worker).  A larger benchmark is dealt to more blocks, long items in pieces that overlap by a window less a word; the documents pass one automaton
after the other and are written between them, so no worker ever holds two, and nothing is left out.

Defined results: null and empty texts have no words and no hits; null items are ignored; repeated rows are scanned each on
their own; extra columns pass through (those named as the added ones are replaced); an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm import shared

#: Fixed values of the word definition: A-Z lower-cased; ASCII letters and digits and all beyond ASCII make words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WINDOW = 13
BLOCK_NODES = 8_000_000
#: Words of a piece of a long item.
PIECE = 2000

RANGE = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(RANGE)), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split(b" ") if text else []


def normalised(text: str | None) -> list[bytes]:
    return [w for w in words(text) if w]


def windows(items: list[tuple[str, str]], size: int = WINDOW) -> dict[str, list[str]]:
    """Window text to the ids of the items that have it."""
    out: dict[str, list[str]] = {}
    for item, text in items:
        w = normalised(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            ids = out.setdefault(f" {b' '.join(w[i : i + size]).decode()} ", [])
            if item not in ids:
                ids.append(item)
    return out


def automaton(patterns: dict[str, list[str]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for text, ids in patterns.items():
        found.add_word(text, (text.count(" ") - 1, ids))
    found.make_automaton()
    return found


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, overlapping and adjacent ranges of words (ends inclusive) made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def match(text: str | None, found: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, ranges of hit words, items that occur."""
    w = normalised(text)
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    if found and w:
        line = f" {b' '.join(w).decode()} "
        ends = [(end, value) for end, value in found.iter(line)]
        if ends:
            spaces = np.flatnonzero(np.array([c == " " for c in line]))
            for (_, (size, ids)), last in zip(ends, np.searchsorted(spaces, [e for e, _ in ends]) - 1, strict=True):
                ranges.append((int(last) - size + 1, int(last)))
                items.update(ids)
    return len(w), joined(ranges), items


def original(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of word ranges."""
    at = [m.span() for m in WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))] if ranges else []
    return [(at[a][0], at[b][1]) for a, b in ranges]


def _pieces(benchmark: DataFrame, size: int, item: str, item_text: str) -> DataFrame:
    """item, text: normalised items of at most PIECE words; of longer ones pieces that have all their windows."""
    lower = F.translate(F.col(item_text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(WORD.pattern), F.lit(0))
    rows = benchmark.select(F.col(item).cast("string").alias("item"), words.alias("w")).where("item is not null and size(w) > 0")
    first = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)), F.lit(PIECE - size + 1))
    return rows.select("item", "w", F.explode(first).alias("i")).select("item", F.array_join(F.slice("w", F.col("i"), F.lit(PIECE)), " ").alias("text"))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text", block_nodes: int = BLOCK_NODES) -> DataFrame:
    """Documents with n_words, hits (word ranges), spans (code points of the original) and items (ids as sorted strings)."""
    spark = docs.sparkSession
    bench = _pieces(benchmark, size, item, item_text)
    total = bench.agg(F.sum(F.char_length("text") + 1)).first()[0] or 0
    n_blocks = -(-total * size // block_nodes) or 1
    names = {f.name for f in ADDED}
    base = docs.select(*[c for c in docs.columns if c not in names])
    out, schema, before = base, T.StructType([*base.schema.fields, *ADDED]), None
    for b in range(n_blocks):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b) if n_blocks > 1 else bench
        # bounded: a block's windows have about block_nodes characters
        held = spark.sparkContext.broadcast({"windows": windows([(r.item, r.text) for r in part.orderBy("item", "text").collect()], size)})
        out = out.mapInArrow(_scanner(held, base.columns, text, schema, first=b == 0), schema)
        if b < n_blocks - 1:
            out = shared.table(out, "scanned")
            if before is not None:
                shared.drop(before)
            before = out
    return out


def _scanner(held, columns, text, schema, first):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = held.value
        if "automaton" not in value:
            value["automaton"] = automaton(value["windows"]) if value["windows"] else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                before = [None] * part.num_rows if first else zip(part.column("hits").to_pylist(), part.column("items").to_pylist(), strict=True)
                for t, old in zip(part.column(text).to_pylist(), before, strict=True):
                    n, ranges, items = match(t, value["automaton"])
                    if old:
                        ranges, items = joined(ranges + [(r["first"], r["last"]) for r in old[0]]), items | set(old[1])
                    rows.append((n, [{"first": a, "last": b} for a, b in ranges], [{"start": a, "end": b} for a, b in original(t or "", ranges)], sorted(items)))
                new = [pa.array(list(c), type=k) for c, k in zip(zip(*rows, strict=True), _arrow(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *new], names=schema.names)

    return run


def _arrow() -> list[pa.DataType]:
    pair = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
    return [pa.int64(), pair("first", "last"), pair("start", "end"), pa.list_(pa.string())]


def hit_words() -> F.Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)


def contaminated(share: int = 20) -> F.Column:
    """At least one hit word, and one in `share` words or more."""
    return (hit_words() > 0) & (hit_words() * share >= F.col("n_words"))

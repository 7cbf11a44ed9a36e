"""Exact substring dedup: bytes covered by a string of LENGTH bytes that also starts earlier, by a sparse, range-partitioned suffix array.

Of every LENGTH consecutive bytes the GRAM-byte string with the least hash is the anchor (the first of equal ones), so equal strings have
equal anchors at equal places, and only suffixes at anchors, about one in 30, have to be sorted.  An anchor stands for the window starts that chose it; its
segment is their bytes.

1. Anchor hashes are dealt by range as packed arrays; a task settles by itself what repeats among its own documents and sends one
   entry for each hash.  Anchors whose hash occurs once are done.
2. For the others the segments are named by hashes of anchor and bytes.  An aggregate finds each name's first occurrence before any
   sort: all windows of all others start earlier there.
3. Only first occurrences whose anchor also stands in other segments need their bytes compared: their suffixes (from the anchor on)
   are range-partitioned by their leading bytes with sampled splitters.  Each
   bucket sorts its suffixes by multikey quicksort over 8-byte characters, and compares windows that share enough of the sorted suffixes' prefixes and
   the bytes before the anchor.  Windows whose prefix is that of a bucket's first or last suffix can have equals in the next
   bucket: their first occurrences are compared across boundaries in one more aggregation.
4. The window runs of a document are made byte runs and cut out.

Defined results: null texts are empty; texts under LENGTH bytes lose nothing; a null doc_id comes before all others; rows that share a doc_id
count as one document given more than once: none is earlier than the other, and all lose what any of them loses; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm import shared, textkit
from veriloom.llm.textkit import U, mix

LENGTH = 100
GRAM = 40
BLOCK = 1 << 18
FLUSH = 4_000_000
#: Suffixes of a bucket, some 40 MB with what is made of them.
BUCKET_ROWS = 100_000
_M = [U(int(x)) for x in mix(np.arange(1, 9, dtype=U)) | U(1)]
_BYTE = mix(np.arange(256, dtype=U) + U(977))
NULL_ID = -(1 << 63)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of every string of `size` bytes, from those of half the length."""
    out, have, level, m = None, 0, _BYTE[data], 1
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    step = 0
    while m <= size:
        if size & m:
            out = level[:n] if out is None else out * _M[step] + level[have : have + n]
            have += m
        if 2 * m <= size:
            level = level[:-m] * _M[step + 1] + level[m:]
        m, step = 2 * m, step + 1
    return mix(out)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, size: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor place, first and last window start it stands for, its hash, and the text it is in."""
    n = len(data)
    hashes = gram_hashes(data, size)
    w = length - size + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, np.int64))
    bits = U(max(1, n.bit_length()))
    least = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=U)
    m = 1
    while 2 * m <= w:
        least = np.minimum(least[:-m], least[m:])
        m *= 2
    if m < w:
        least = np.minimum(least[: n - length + 1], least[w - m : w - m + n - length + 1])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
    starts = np.flatnonzero(owner == np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[length - 1 :])
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, np.int64))
    at = (least[starts] & ((U(1) << bits) - U(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])]))
    end = np.concatenate([new[1:], [len(starts)]]) - 1
    return at[new], starts[new], starts[end], hashes[at[new]], owner[starts[new]]


def _packed(ranges: int):
    """Documents to packed anchor entries: what repeats within the task is settled here (kind 0), one entry a hash goes on (kind 1)."""
    names = ["r", "kind", "docs", "high", "low", "at", "place"]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]

    def flush(held: list[tuple]) -> pa.RecordBatch:
        h, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, doc, place = h[order], doc[order], place[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        several = np.repeat(np.diff(np.flatnonzero(np.concatenate([first, [True]]))) > 1, np.diff(np.flatnonzero(np.concatenate([first, [True]]))))
        rows = []

        def put(r: int, kind: int, h: np.ndarray, d: np.ndarray, p: np.ndarray, known: np.ndarray) -> None:
            ids, at = np.unique(d, return_inverse=True)
            short = (h >> U(24)).astype(U)  # 40 bits: more than enough to tell hashes of one range apart; a chance match only means more to compare
            rows.append((r, kind, ids.tobytes(), (short >> U(32)).astype(np.uint8).tobytes(), short.astype(np.uint32).tobytes(), at.astype(np.uint32).tobytes(), ((p.astype(U) << U(1)) | known.astype(U)).astype(U).tobytes() if p.max(initial=0) >= 1 << 31 else ((p.astype(np.uint32) << np.uint32(1)) | known).astype(np.uint32).tobytes()))

        own = np.flatnonzero(several)
        for i, part in enumerate(np.array_split(own, max(1, len(own) // 2000))):
            if len(part):
                put(int((h[part[0]] + U(i)) % U(ranges)), 0, h[part], doc[part], place[part], several[part])
        one = np.flatnonzero(first)
        # ranges by the low bits, which the 40 kept bits don't hold
        r = ((h[one] & U(0xFFFFFF)) % U(ranges)).astype(np.int64)
        by = np.argsort(r, kind="stable")
        cuts = np.searchsorted(r[by], np.arange(ranges + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            part = one[by[cuts[i] : cuts[i + 1]]]
            put(int(i), 1, h[part], doc[part], place[part], several[part])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a, _, data, offsets in textkit.blocks(batch.column("text"), BLOCK):
                at, _, _, h, owner = anchors(data, offsets)
                if len(at):
                    held.append((h, ids[a + owner], at - offsets[owner]))
                    size += len(at)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of whole ranges, sorted by range: document and places of anchors whose hash occurs more than once."""

    def places(r: dict) -> np.ndarray:
        wide = len(r["place"]) == 8 * len(r["high"])
        return np.frombuffer(r["place"], U if wide else np.uint32).astype(U)

    def out(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place.astype(np.int64))], names=["doc_id", "place"])

    def settle(rows: list[dict]) -> pa.RecordBatch:
        h = np.concatenate([(np.frombuffer(r["high"], np.uint8).astype(U) << U(32)) | np.frombuffer(r["low"], np.uint32).astype(U) for r in rows])
        doc = np.concatenate([np.frombuffer(r["docs"], np.int64)[np.frombuffer(r["at"], np.uint32)] for r in rows])
        place = np.concatenate([places(r) for r in rows])
        order = np.argsort(h, kind="stable")
        h = h[order]
        twice = np.zeros(len(h), dtype=bool)
        twice[1:] = h[1:] == h[:-1]
        twice[:-1] |= twice[1:]
        pick = order[twice]
        pick = pick[place[pick] & U(1) == 0]
        return out(doc[pick], place[pick] >> U(1))

    now, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if r["kind"] == 0:
                yield out(np.frombuffer(r["docs"], np.int64)[np.frombuffer(r["at"], np.uint32)], places(r) >> U(1))
                continue
            if r["r"] != now and rows:
                yield settle(rows)
                rows = []
            now = r["r"]
            rows.append(r)
    if rows:
        yield settle(rows)


def _chosen(batch: pa.RecordBatch, column: str, pick: str):
    """Blocks of the documents with their anchors that stand at the places asked for (pick: "at"), or whose first window does."""
    ids, asked = batch.column("doc_id").to_numpy(), batch.column(column)
    for a, b, data, offsets in textkit.blocks(batch.column("text"), BLOCK):
        at, first, last, h, owner = anchors(data, offsets)
        wanted = np.concatenate([asked[a + i].values.to_numpy() + offsets[i] for i in range(b - a)] or [np.zeros(0, np.int64)])
        keep = np.flatnonzero(np.isin(at if pick == "at" else first, wanted))
        if len(keep):
            at, first, last, h, owner = (x[keep] for x in (at, first, last, h, owner))
            yield data, at, first, last, h, ids[a + owner], first - offsets[owner]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the places of their repeated anchors: the names of these anchors' segments, and whether the document had one before."""
    names = ["gram", "segment", "doc_id", "start", "windows", "again"]
    for batch in batches:
        for data, at, first, last, h, doc, start in _chosen(batch, "places", "at"):
            base = 0x9E3779B97F4A7C15
            up, down = textkit.powers(base, len(data)), textkit.powers(pow(base, -1, 1 << 64), len(data))
            total = np.zeros(len(data) + 1, U)
            np.cumsum(_BYTE[data] * up, out=total[1:])
            name = mix((total[last + LENGTH] - total[first]) * down[first] + mix((at - first).astype(U)) + (last - first).astype(U))
            order = np.lexsort((start, name, h, doc))
            same = np.zeros(len(order), dtype=bool)
            o = order
            same[1:] = (doc[o][1:] == doc[o][:-1]) & (h[o][1:] == h[o][:-1]) & (name[o][1:] == name[o][:-1])
            again = np.zeros(len(order), dtype=bool)
            again[order] = same
            columns = [h.view(np.int64), name.view(np.int64), doc, start.astype(np.int32), (last - first + 1).astype(np.int32), again]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the first windows of segments: these segments' bytes before the anchor and from it on."""
    names, kinds = ["doc_id", "start", "windows", "left", "right"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        for data, at, first, last, _, doc, start in _chosen(batch, "starts", "first"):
            raw = data.tobytes()
            left = [raw[i:j] for i, j in zip(first, at, strict=True)]
            right = [raw[i:j] for i, j in zip(at, last + LENGTH, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([doc, start, last - first + 1, left, right], kinds, strict=True)], names=names)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of big-endian 8-byte characters by multikey quicksort: each character in turn parts only what is still tied.

    Returns the order and, for each place but the first, the number of whole characters that it shares with the one before.
    """
    n, width = words.shape
    order, group = np.arange(n), np.zeros(n, dtype=np.int64)
    common = np.full(n, width, dtype=np.int64)
    common[:1] = 0
    tied = np.arange(n)
    for j in range(width):
        if len(tied) < 2:
            break
        rows = order[tied]
        by = np.lexsort((words[rows, j], group[tied]))
        order[tied] = rows[by]
        value, g = words[order[tied], j], group[tied]
        same_group = np.concatenate([[False], g[1:] == g[:-1]])
        split = same_group & np.concatenate([[False], value[1:] != value[:-1]])
        common[tied[split]] = j
        new = np.cumsum(~same_group | split)
        group[tied] = new
        counts = np.bincount(new)
        tied = tied[counts[new] > 1]
    return order, common


def _matrix(rows: list[bytes], width: int, tail: bool = False) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.frombuffer(b"".join(rows), np.uint8)
    out = np.zeros((len(rows), width), np.uint8)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(rows)), sizes)
    column = np.arange(len(flat)) - starts[owner]
    if tail:  # last byte in column 0
        column = sizes[owner] - 1 - column
    keep = column < width
    out[owner[keep], column[keep]] = flat[keep]
    return out, sizes


def compare(left: list[bytes], right: list[bytes], windows: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One bucket of distinct segments: rows and windows (index in the segment) that start earlier in the bucket, and the rows
    and windows that are first here but could have equals in another bucket."""
    n = len(left)
    # no window looks at more than LENGTH bytes from the anchor on
    text, right_size = _matrix(right, -(-LENGTH // 8) * 8)
    order, common = multikey_order(text.view(">u8"))
    text = text[order]
    lcp = np.minimum(common * 8, LENGTH)
    part = np.flatnonzero(common < text.shape[1] // 8)
    part = part[part > 0]
    if len(part):
        a, b, c = text[part - 1], text[part], common[part] * 8
        differ = (a != b) & (np.arange(text.shape[1])[None, :] >= c[:, None])
        lcp[part] = np.minimum(np.argmax(differ, axis=1), LENGTH)
    lcp[:1] = 0
    from_first = np.minimum.accumulate(np.concatenate([[LENGTH], lcp[1:]]))
    from_last = np.minimum.accumulate(np.concatenate([[LENGTH], lcp[1:][::-1]]))[::-1]
    back, left_size = _matrix(left, LENGTH, tail=True)
    back, left_size, windows, doc, start = back[order], left_size[order], windows[order], doc[order], start[order]
    behind = np.zeros(n, U)
    again, opened = [], []
    for r in range(LENGTH - GRAM + 1):  # bytes of the window before the anchor
        if r:
            behind = mix(behind + _BYTE[back[:, r - 1]] * _M[r % 8])
        index = left_size - r
        has = np.flatnonzero((index >= 0) & (index < windows))
        if not len(has):
            continue
        need = LENGTH - r
        group = np.cumsum(lcp < need)[has]
        key = mix(group.astype(U) + mix(behind[has]))
        by = np.lexsort((start[has] + index[has], doc[has], key))
        first = np.concatenate([[True], key[by][1:] != key[by][:-1]])
        late = has[by[~first]]
        again.append((late, index[late]))
        early = has[by[first]]
        early = early[(from_first[early] >= need) | (from_last[early] >= need)]
        opened.append((early, index[early]))
    both = []
    for found in (again, opened):
        rows = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        both += [order[rows], np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)]
    return tuple(both)


def runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts of documents as maximal runs: document, first, last."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    if not len(doc):
        return doc, at, at
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)]))
    return doc[cut], at[cut], at[np.concatenate([cut[1:], [len(doc)]]) - 1]


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "first", "last", "h1", "h2"]
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    left, right = table["left"].to_pylist(), table["right"].to_pylist()
    windows, doc, start = (table[c].to_numpy() for c in ("windows", "doc_id", "start"))
    rows, index, open_rows, open_index = compare(left, right, windows, doc, start)
    d, a, b = runs(doc[rows], start[rows] + index)
    none = pa.nulls(len(d), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b), none, none], names=names)
    for i in range(0, len(open_rows), 20_000):
        digests = [hashlib.blake2b((left[x] + right[x])[w : w + LENGTH], digest_size=16).digest() for x, w in zip(open_rows[i : i + 20_000], open_index[i : i + 20_000], strict=True)]
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        at = start[open_rows[i : i + 20_000]] + open_index[i : i + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(doc[open_rows[i : i + 20_000]]), pa.array(at), pa.array(at), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=names)


def _places(docs: DataFrame, n: int) -> DataFrame:
    """Step 1: doc_id, place of the anchors whose hash occurs more than once."""
    entry = "r int, kind int, docs binary, high binary, low binary, at binary, place binary"
    dealt = docs.mapInArrow(_packed(n), entry).repartition(n, "r").sortWithinPartitions("r")
    return shared.table(dealt.mapInArrow(_shared, "doc_id long, place long"), "places")


def _named(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Step 2: the segments of these anchors by name."""
    wanted = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    return shared.table(docs.join(wanted, "doc_id").mapInArrow(_segments, "gram long, segment long, doc_id long, start int, windows int, again boolean"), "segments")


def _copied(segments: DataFrame, first: DataFrame) -> DataFrame:
    """All windows of segments that aren't their name's first: they start earlier."""
    late = segments.join(first.select("gram", "segment", F.col("doc_id").alias("least")), ["gram", "segment"]).where("again or doc_id > least")
    return shared.table(late.select("doc_id", F.col("start").cast("long").alias("first"), (F.col("start") + F.col("windows") - 1).cast("long").alias("last")), "copied")


def _compared(docs: DataFrame, first: DataFrame, n: int) -> DataFrame:
    """Step 3: the first occurrences of segments that share their anchor with others, as sorted suffixes."""
    several = first.groupBy("gram").agg(F.min("segment").alias("lo"), F.max("segment").alias("hi")).where("lo < hi").select("gram")
    starts = first.join(several, "gram").groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    starts = shared.table(starts, "starts")
    # a bucket is read whole: of about BUCKET_ROWS suffixes, those of equal leading bytes dealt to several by what else tells them apart
    buckets = max(n, -(-(starts.agg(F.sum(F.size("starts"))).first()[0] or 0) // BUCKET_ROWS))
    suffixes = docs.join(starts, "doc_id").mapInArrow(_bytes, "doc_id long, start long, windows long, left binary, right binary")
    found = shared.table(suffixes.repartitionByRange(buckets, "right", "left", "doc_id", "start").mapInArrow(_bucket, "doc_id long, first long, last long, h1 long, h2 long"), "compared")
    shared.drop(starts)
    return found


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, first, last: runs of window starts whose LENGTH bytes also start earlier.  docs: doc_id long, text string, no nulls.

    Each step's result is a table, so its shuffle files can go before the next step needs the room.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = _places(docs, n)
    shared.release(spark)
    segments = _named(docs, places)
    shared.drop(places)
    shared.release(spark)
    first = shared.table(segments.where("not again").groupBy("gram", "segment").agg(F.min("doc_id").alias("doc_id"), F.min_by("start", "doc_id").alias("start")), "first")
    shared.release(spark)
    copied = _copied(segments, first)
    shared.drop(segments)
    shared.release(spark)
    found = _compared(docs, first, n)
    shared.drop(first)
    shared.release(spark)
    order = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 40).cast("decimal(13,0)") + F.col("first").cast("decimal(13,0)")
    border = found.where("h1 is not null").withColumn("position", order.cast("decimal(38,0)"))
    least = border.groupBy("h1", "h2").agg(F.min("position").alias("least"))
    crossing = border.join(least, ["h1", "h2"]).where("position > least").select("doc_id", "first", "last")
    return copied.union(found.where("h1 is null").select("doc_id", "first", "last")).union(crossing)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part, rows = batch.slice(begin, 256), []
            for doc, text, found in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for a, b in sorted((r["first"], min(r["last"] + LENGTH, len(raw))) for r in found or []):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    elif a < b:
                        spans.append([a, b])
                edges = [0, *[x for s in spans for x in s], len(raw)]
                kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                rows.append((doc, len(raw), len(raw) - len(kept), [{"start": a, "end": b} for a, b in spans], kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs, bytes, ends exclusive), kept (the other bytes)."""
    given = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = shared.table(repeated_windows(given).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")
    shared.release(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    out = given.join(found, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(_cut, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))

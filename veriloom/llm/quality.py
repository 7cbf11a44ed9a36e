"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Word unigrams and bigrams are hashed into two tables of BUCKETS cells.  The raw model counts all documents; the target model those
of a bounded sample of labelled rows (at most `max_labelled`, the first by a hash of the id) of good quality that aren't toxic.  Both models
have PRIOR counts more in every cell, after the raw one is scaled to the target's size.  A document's log weight is the sum over its n-grams of
log p_target - log p_raw: the importance ratio of the whole document.  Adding standard Gumbel noise to the log weights and keeping the k
largest samples k documents without replacement, each draw in proportion to the weights.  k is a parameter; where it isn't given it is the number of
documents, out of all, whose log weight reaches the level that separates the labelled sample best while `keep` of its good documents pass, so
the noise decides among the documents around that level, and two seeds keep different ones of them.

Toxic documents are mostly ordinary prose, so no mean finds them: they have a ratio of their own, of how many toxic and how many other
labelled documents hold an n-gram.  The sum of a document's TOP largest positive ones is its toxicity, and those beyond the level that
separates toxic from good documents best, while `keep` of the good ones pass, are rejected before the sampling.  In both models a
labelled document's own n-grams don't count for it, so the levels hold for documents without a label.

What reaches the driver is bounded: 8 * BUCKETS counts and a few, the labelled sample's scores, and histograms of BINS cells.

Defined results: null texts and texts without words have no n-grams and are rejected; without labels of both kinds nothing else is, and without toxic labels nothing is toxic;
a null toxic label counts as not toxic;
noise depends on (seed, id) only, for a null id on the text, so reruns agree, and repeated rows share their fate; rows tied with the k-th key stay;
ids that two texts share are two documents, told apart by text_hash; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm import shared, textkit

BITS = 17
BUCKETS = 1 << BITS
SLICE = 1 << 12
MAX_LABELLED = 50_000
PRIOR = 60.0
KEEP = 0.99
TOP = 3
BINS = 65536
SEED = "quality"


def features(hasher: textkit.Hasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of every n-gram (bigrams in the second half) and the text it is in."""
    _, _, hashes, first = hasher.words(data, offsets)
    pairs, at = textkit.shingles(hashes, first, 2)
    cells = np.concatenate([(hashes >> textkit.U(64 - BITS)), (pairs >> textkit.U(64 - BITS)) + textkit.U(BUCKETS)]).astype(np.int64)
    return cells, np.concatenate([np.repeat(np.arange(len(offsets) - 1), np.diff(first)), at])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of all and of target documents; toxic and other labelled documents that hold each; in the last slice how many of these there are."""
    hasher, counts, documents = textkit.Hasher(), np.zeros((4, 2 * BUCKETS), dtype=np.int64), np.zeros((1, SLICE), dtype=np.int64)
    for batch in batches:
        good, kind = batch.column("target").to_numpy(zero_copy_only=False), batch.column("kind").to_numpy()
        documents[0, :3] += np.bincount(kind, minlength=3)
        for a, b, data, offsets in textkit.blocks(batch.column("text")):
            cells, at = features(hasher, data, offsets)
            counts[0] += np.bincount(cells, minlength=2 * BUCKETS)
            counts[1] += np.bincount(cells[good[a:b][at]], minlength=2 * BUCKETS)
            mine = kind[a:b][at] > 0
            held = np.unique(at[mine] * (2 * BUCKETS) + cells[mine])
            for k in (1, 2):
                counts[1 + k] += np.bincount(held[kind[a:b][held // (2 * BUCKETS)] == k] % (2 * BUCKETS), minlength=2 * BUCKETS)
    cut = np.concatenate([counts.reshape(-1, SLICE), documents])
    full = np.flatnonzero(cut.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([cut[i].tobytes() for i in full], pa.binary())], names=["slice", "counts"])


def _sum(pdf):
    import pandas as pd

    total = np.zeros(SLICE, dtype=np.int64)
    for c in pdf["counts"]:
        total += np.frombuffer(c, dtype=np.int64)
    return pd.DataFrame({"slice": pdf["slice"][:1], "counts": [total.tobytes()]})


def sample_labels(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, target (good quality and not toxic), kind (1: toxic, 2: not); one row for an id; bounded, so it may be broadcast."""
    toxic = F.max(F.coalesce(F.col("toxic"), F.lit(0))) == 1 if "toxic" in labels.columns else F.lit(False)
    known = labels.where("doc_id is not null and quality is not null" + (" or doc_id is not null and toxic = 1" if "toxic" in labels.columns else ""))
    one = known.groupBy("doc_id").agg((F.coalesce(F.min("quality") == 1, F.lit(False)) & ~toxic).alias("target"), F.when(toxic, 1).otherwise(2).alias("kind"), (F.coalesce(F.min("quality") != 1, F.lit(False))).alias("low"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def marked(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Add target and kind (0 without a label) to the documents."""
    base = docs.select(*[c for c in docs.columns if c not in ("target", "kind", "low")])
    out = base.join(F.broadcast(sample.select("doc_id", "target", "kind")), "doc_id", "left")
    return out.withColumns({"target": F.coalesce("target", F.lit(False)), "kind": F.coalesce("kind", F.lit(0))})


def evidence(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, smoothing: float = 2.0) -> np.ndarray:
    """How much more often toxic documents hold a cell, as a logarithm (0 for cells in none), for unlabelled, toxic and other documents, which don't count themselves."""
    if not n_toxic or not n_other:
        return np.zeros((3, len(toxic)), dtype=np.float32)
    share = n_toxic / (n_toxic + n_other)

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.log((a + smoothing * share) / n_toxic) - np.log((b + smoothing * (1 - share)) / n_other)
        return np.where(out > 1e-6, out, 0)  # a cell that nobody holds has none, whatever rounding makes of it

    return np.stack([ratio(toxic, other), ratio(np.maximum(toxic - 1, 0), other), ratio(toxic, np.maximum(other - 1, 0))]).astype(np.float32)


def fit(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of all documents and of target ones (unigrams, then bigrams), and the evidence of toxicity, of every cell."""
    summed = marked(docs.select("doc_id", "text"), sample).select("text", "target", "kind").mapInArrow(_count, "slice int, counts binary").groupBy("slice").applyInPandas(_sum, "slice int, counts binary")
    counts = np.zeros((8 * BUCKETS // SLICE + 1, SLICE))
    for r in summed.collect():
        counts[r["slice"]] = np.frombuffer(r["counts"], dtype=np.int64)
    tokens, held, documents = counts[: 4 * BUCKETS // SLICE], counts[4 * BUCKETS // SLICE : -1].reshape(2, 2 * BUCKETS), counts[-1]
    raw, target = tokens.reshape(2, 2 * BUCKETS)
    return raw, target, evidence(held[0], held[1], int(documents[1]), int(documents[2]))


def log_ratio(raw: np.ndarray, target: np.ndarray, totals: tuple[np.ndarray, np.ndarray], half: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log p_target - log p_raw of cells with these counts.  totals: all n-grams of the raw and the target model, by half (unigrams, bigrams)."""
    scale = totals[1] / np.maximum(totals[0], 1)
    return np.log((target + prior) / (raw * scale[half] + prior))


def toxicity(cells: np.ndarray, at: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """For each of n texts the sum of the TOP largest positive values of its different cells."""
    some = np.flatnonzero(values > 0)
    _, one = np.unique(at[some] * (2 * BUCKETS) + cells[some], return_index=True)
    some = some[one]
    some = some[np.lexsort((-values[some], at[some]))]
    rank = np.arange(len(some)) - np.searchsorted(at[some], at[some])
    some = some[rank < TOP]
    return np.bincount(at[some], weights=values[some], minlength=n)


def score(docs: DataFrame, raw: np.ndarray, target: np.ndarray, toxic: np.ndarray, sample: DataFrame, prior: float = PRIOR) -> DataFrame:
    """doc_id, text_hash, log_weight (null without n-grams; a target document's own n-grams don't count in the target model) and toxicity."""
    held = docs.sparkSession.sparkContext.broadcast((raw, target, toxic))
    base = marked(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (raw, target, tables) = textkit.Hasher(), held.value
        totals = raw.reshape(2, BUCKETS).sum(axis=1), target.reshape(2, BUCKETS).sum(axis=1)
        halves = np.repeat(np.arange(2), BUCKETS)
        weights = log_ratio(raw, target, totals, halves, prior)
        for batch in batches:
            sums, toxic, kind = np.full(batch.num_rows, np.nan), np.zeros(batch.num_rows), batch.column("kind").to_numpy()
            good = batch.column("target").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in textkit.blocks(batch.column("text")):
                cells, at = features(hasher, data, offsets)
                n = np.bincount(at, minlength=b - a)
                sums[a:b] = np.where(n > 0, np.bincount(at, weights=weights[cells], minlength=b - a), np.nan)
                for i in np.flatnonzero(good[a:b] & (n > 0)):
                    cell, times = np.unique(cells[at == i], return_counts=True)
                    own = np.bincount(halves[cell], weights=times, minlength=2)
                    sums[a + i] = (log_ratio(raw[cell], target[cell] - times, (totals[0], totals[1] - own), halves[cell], prior) * times).sum()
                toxic[a:b] = toxicity(cells, at, b - a, tables[kind[a:b][at], cells])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sums, pa.float64(), from_pandas=True), pa.array(toxic)], names=["doc_id", "text_hash", "log_weight", "toxicity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, text_hash long, log_weight double, toxicity double")


def level(sample: list[tuple[float, bool]], keep: float = KEEP) -> float:
    """The value that splits labelled rows with the best balanced accuracy among those that let `keep` of the good ones pass."""
    values = np.array([s for s, _ in sample], dtype=float)
    good = np.array([g for _, g in sample], dtype=bool)
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(values, kind="stable")
    v, g = values[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    caught = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    cuts = np.flatnonzero((lost <= 1 - keep) & np.concatenate([[True], v[1:] > v[:-1], [False]]))
    return float(v[cuts[np.argmax(caught[cuts] - lost[cuts])]])


def kth_largest(keys: DataFrame, key: str, k: int) -> float:
    """Exact, by histograms of BINS cells over ever narrower ranges; no sort of the whole."""
    if k <= 0:
        return float("inf")
    low, high = keys.agg(F.min(key), F.max(key)).first()
    above = 0
    while low is not None and low < high:
        cell = F.least(F.floor((F.col(key) - low) / (high - low) * BINS), F.lit(BINS - 1)).cast("long")
        cells = keys.where(F.col(key).between(low, high)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("b"))
        for r in sorted(cells.collect(), key=lambda r: -r["cell"]):
            if above + r["n"] >= k:
                low, high = r["a"], r["b"]
                break
            above += r["n"]
        else:
            break
    return float("-inf") if low is None else low


def keyed(scored: DataFrame, seed: str = SEED) -> DataFrame:
    """Add key: the log weight with standard Gumbel noise."""
    told = F.when(F.col("doc_id").isNull(), F.col("text_hash"))
    unit = (F.abs(F.xxhash64(F.lit(seed), "doc_id", told) % (1 << 52)) + 0.5) / float(1 << 52)
    return scored.withColumn("key", F.col("log_weight") - F.log(-F.log(unit)))


def gumbel_top(rows: DataFrame, k: int) -> DataFrame:
    """The k rows of the largest keys, and those tied with the last of them."""
    return rows.where(F.col("key") >= F.lit(kth_largest(rows, "key", k)))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, max_labelled: int = MAX_LABELLED, prior: float = PRIOR, keep: float = KEEP, seed: str = SEED) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), log_weight, key of the documents that are kept (narrow rows; semi-join the documents with them)."""
    sample = shared.cut(sample_labels(labels, max_labelled))
    scored = score(docs, *fit(docs, sample), sample, prior).where("log_weight is not null")
    rows = shared.cut(keyed(scored, seed))
    known = rows.join(F.broadcast(sample), "doc_id").select("log_weight", "toxicity", "target", "kind", "low").limit(2 * max_labelled).collect()
    most = -level([(-r["toxicity"], r["target"]) for r in known if r["target"] or r["kind"] == 1], keep)
    if not any(r["kind"] == 1 and r["toxicity"] > most for r in known):
        most = float("inf")
    rows = rows.where(F.col("toxicity") <= F.lit(most)).drop("toxicity")
    if k is None:
        cut = level([(r["log_weight"], r["target"]) for r in known if (r["target"] or r["low"]) and r["toxicity"] <= most], keep)
        k = rows.where(F.col("log_weight") >= F.lit(cut)).count()
    return gumbel_top(rows, k)


def kept(docs: DataFrame, sampled: DataFrame) -> DataFrame:
    """The documents that were sampled, whole rows, those without an id too."""
    mine, theirs = docs.withColumn("__hash", F.xxhash64("text")), sampled.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).distinct()
    return mine.join(theirs, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text")), "left_semi").drop("__hash")

"""The pipeline's stages keep their promises on the smallest table."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F
from test_operators import LOWER, WORD, brute_groups, prose

from veriloom.llm import mixing, ngram_join, quality, secrets

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF).persist()
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(ids) <= set(seen), name
        if name != "mixed":
            assert out.columns == p.COLUMNS and len(ids) == len(set(ids))
            gone = set(seen) - set(ids)
            texts = {r.doc_id: r.text for r in out.collect()}
            if name == "no_secrets":
                assert not gone
            if name == "one_of_each":
                assert len(set(texts.values())) == len(texts)
            if name == "no_secrets":
                assert secrets.scan(out).where("exists(base_spans, s -> s.rank > 0)").count() == 0
            seen = texts
        docs = out
    rows = docs.collect()
    assert all(0 <= r.position <= 1 for r in rows) and len({(r.doc_id, r.copy) for r in rows}) == len(rows)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Rows of all kinds: near and exact copies, benchmark passages in long and short texts, secrets, null and repeated ids, null, empty and odd texts."""
    rng = random.Random(40)
    folder = tmp_path_factory.mktemp("corpus")
    items = [(i, prose(rng, n, 3000)) for i, n in enumerate((6, 13, 20, 40))] + [(9, None), (10, "")]
    rows = [(i, prose(rng, rng.randint(20, 120), 3000), "en", f"s{i % 3}") for i in range(90)]
    for i in range(100, 130):  # near and exact copies
        words = rows[i % 7][1].split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "s1"))
    rows += [(200, prose(rng, 900, 3000) + " " + items[2][1].upper() + ", " + prose(rng, 900, 3000), "en", "s0"), (201, items[1][1], "en", "s0"), (202, prose(rng, 30, 3000) + " " + items[0][1], "en", "s2")]
    rows += [(210, "my password = hunter22 and " + prose(rng, 30, 3000), "en", "s0"), (211, prose(rng, 25, 3000) + " key aB3dE5fG7hJ9kL1mN2pQ4rS6 end", "en", None)]
    rows += [(None, prose(rng, 40, 3000), "en", "s0"), (None, rows[0][1], None, "s1"), (220, None, "en", "s0"), (221, "", "en", "s0"), (222, " \n", "en", "s0"), (5, rows[5][1], "en", "s2"), (6, prose(rng, 50, 3000), "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, hits string")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, int(i % 9 > 0), 0) for i in range(0, 90, 2)] + [(None, 0, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, [(i, t) for i, t, _, _ in rows], [(str(i), t) for i, t in items], str(folder)


def shown(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_each_stage_equals_brute_force(spark, corpus):
    import corpus_pipeline as p

    docs, rows, items, folder = corpus
    order = lambda pairs: sorted(pairs, key=repr)

    sampled = {(r.doc_id, r.text_hash) for r in quality.resample(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    good = p.good_quality(spark, docs, folder)
    assert good.columns == p.COLUMNS and shown(good) == order((i, t) for i, t in rows if (i, hashes[t]) in sampled)
    assert not {220, 221, 222} & {i for i, _ in shown(good)} and any(i is None for i, _ in shown(good))

    group = brute_groups(rows, 5, (80, 100))
    assert shown(p.one_of_each(spark, docs, folder)) == order((i, t) for i, t in rows if i is None or group[i] == i)

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOWER))
    windows = {tuple(w[j : j + 13]) for _, t in items if (w := cut(t)) for j in range(max(1, len(w) - 12))}
    holds = lambda t: any(tuple(w[j : j + n]) in windows for w in [cut(t)] for n in {len(x) for x in windows} for j in range(len(w) - n + 1))
    left = shown(p.not_in_benchmark(spark, docs, folder))
    assert left == order((i, t) for i, t in rows if not holds(t)) and not {200, 201, 202} & {i for i, _ in left}

    def cleaned(text, spans):
        out, at = "", 0
        for a, b in spans:
            if a > at or not out:
                out += text[at:a] + "[REDACTED]"
            at = max(at, b)
        return out + text[at:] if spans else text

    found = {r.text: [(s.start, s.end) for s in r.all_spans] for r in secrets.scan(docs).collect()}
    clean = p.no_secrets(spark, docs, folder)
    assert shown(clean) == order((i, cleaned(t, found[t]) if t else t) for i, t in rows) and "hunter22" not in repr(clean.collect())
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean.collect())

    mix = p.mixed(spark, docs, folder).collect()
    plan = mixing.allocate(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.position) for r in mix) == sorted((r.doc_id is not None, r.doc_id or 0, r.size, x) for r in plan for x in r.positions)
    assert [r.position for r in mix] == sorted(r.position for r in mix) and not {220, 221, 222} & {r.doc_id for r in mix}
    size = lambda t: len(WORD.findall(t or ""))
    assert sum(r.size for r in mix) <= 3 * sum(size(t) for _, t in rows) and {r.size for r in mix} <= {size(t) for _, t in rows}


def test_stages_of_an_empty_table(spark, corpus):
    import corpus_pipeline as p

    docs, _, _, folder = corpus
    for name, stage in p.STAGES:
        out = stage(spark, docs.where("doc_id < -1"), folder)
        assert out.count() == 0 and (name == "mixed" or out.columns == p.COLUMNS)


def test_one_of_each_asks_for_little_at_the_driver(spark, corpus, monkeypatch):
    """The bitmap of the documents that are tried is as large as they are many, not 16 MB for a few."""
    import corpus_pipeline as p

    made, marks = [], ngram_join._marks
    monkeypatch.setattr(ngram_join, "_marks", lambda *a: made.append(marks(*a)) or made[-1])
    assert p.one_of_each(spark, corpus[0], "").count() > 0 and made[0].any() and len(made[0]) <= 1 << 16

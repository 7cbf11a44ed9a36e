"""Secrets, chat and mixing, against plain Python."""

import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from veriloom.llm import chat, mixing, secrets

KEY = "aB3dE5fG7hJ9kL1mN2pQ4rS6"


def brute_spans(text):
    out = []
    for kind, pattern, ok in (
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), secrets.KINDS.index(kind), m.end(), kind) for m in re.finditer(pattern, text or "") if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_equal_a_plain_scan(spark):
    rng = random.Random(3)
    parts = ["token", "secret = token : abcdef123", "Password='hunter22'", "api_key:", "apikey = x", "AKIA" + "A1" * 9, "AKIAAKIA", "deadbeef" * 4, "0123456789abcdef01234567", "ééé", " ", "\n", "=", ": ", "abc", KEY, "passwd"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(120)] + [None, "", "x" * 50_000 + " token=abcdef1 " + "f" * 30]
    rows = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "id int, text string, base string")
    got = {r.id: r for r in secrets.scan(rows).select("id", "base", secrets.listed(F.col("base_spans")).alias("a"), secrets.listed(F.col("all_spans")).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i].a == brute_spans(t), t
        assert set(got[i].a.split(",")) - {""} <= set(got[i].b.split(",")) and got[i].base == "keep"


def test_entropy_layer(spark):
    texts = [f"key {KEY} end", "a-slug-made-of-many-ordinary-words here", "id 123e4567-e89b-12d3-a456-426614174000", "AAAAAAAAAAAAAAAAAAAAAAAAA1a", f"example{KEY}", "Donaudampfschifffahrtsgesellschaft", f"token={KEY}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r.s for r in secrets.scan(rows).orderBy("id").select(secrets.listed(F.col("all_spans")).alias("s")).collect()]
    assert got == ["entropy:4:28", "", "", "", "", "", "assign:0:30"]


def test_window_entropy(spark):
    runs = ["aaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghijklmnopqrstuvwxyz", "ab" * 20, KEY, "x", "aab"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(runs)], "id int, run string")
    for r in rows.select("run", secrets.window_entropy(F.col("run")).alias("h")).collect():
        w = min(20, len(r.run))
        best = max(-sum(c / w * math.log2(c / w) for c in Counter(r.run[i : i + w]).values()) for i in range(len(r.run) - w + 1))
        assert abs(r.h - best) < 1e-9


def test_rest_of_a_run_is_scored(spark):
    """What stands beside a base span in its run, and a random part beside a harmless one, are found; a harmless part alone isn't."""
    access = "AKIA" + "A1B2" * 5
    texts = [f"{access}/{KEY}", f"example/{KEY}", f"path/{KEY}/sample", f"lorem/example{KEY}", f"x={KEY}", "some/path/without/numbers/at/all"]
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "id int, text string, base_spans int, __base int")
    got = [r.s for r in secrets.scan(rows).orderBy("id").select(secrets.listed(F.col("all_spans")).alias("s")).collect()]
    assert got == ["access:0:24,entropy:24:49", "entropy:0:32", "entropy:0:36", "", "entropy:0:26", ""]
    clean = secrets.redact(rows).orderBy("id").collect()
    assert clean[0].text == "[REDACTED]" and clean[0].base_spans == 1 and clean[0]["__base"] == 2


def test_texts_of_many_spans(spark):
    """Two texts of a megabyte, one of 20,000 hex words and one run without a break: positions stay exact and time stays linear."""
    rng = random.Random(24)
    words = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(32)) + " é" for _ in range(20_000))
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+") for _ in range(300_000))
    rows = spark.createDataFrame([(0, words), (1, run), (2, "\x01 token=abcdef1 " + words[:100])], "id int, text string")
    began = time.time()
    got = {r.id: r for r in secrets.scan(rows).select("id", "text", F.size("base_spans").alias("n"), secrets.listed(F.col("base_spans")).alias("a"), F.size("all_spans").alias("m")).collect()}
    assert got[0].n == 20_000 == got[0].m and got[0].a == brute_spans(words) and got[1].m == 1
    clean = {r.id: r.text for r in secrets.redact(rows).collect()}
    assert clean[0] == " ".join(["[REDACTED] é"] * 20_000) and clean[1] == "[REDACTED]" and clean[2] == "\x01 [REDACTED] " + "[REDACTED] é [REDACTED] é [REDACTED]"[: len("[REDACTED] é [REDACTED] é [REDACTED]")]
    assert time.time() - began < 120


def test_redaction(spark):
    rows = spark.createDataFrame([(1, "a token=abcdef1 b", 5), (2, None, 6), (3, "", 7), (4, "plain", 8), (5, "é token=" + "0123456789abcdef" * 2, 9)], "doc_id int, text string, spans int")
    got = {r.doc_id: (r.text, r.spans) for r in secrets.redact(rows).collect()}
    assert got == {1: ("a [REDACTED] b", 5), 2: (None, 6), 3: ("", 7), 4: ("plain", 8), 5: ("é [REDACTED]", 9)}
    assert secrets.redact(rows.where("doc_id > 9")).count() == 0


def test_chat_round_trip(spark):
    odd = ["", None, "\\### Assistant: </turn> ok", "<turn assistant>\nx</turn>\n", "\\b\\l\\\\<>", "é\n\n", "</turn>\n</turn>\n"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a>\nb<\\"]), rng.choice(odd), 1) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(99, 0, "user", "x", 1), (99, 0, "user", "x", 1), (None, None, "assistant", "y", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    out = chat.examples(frame).withColumn("parsed", chat.parse(F.col("formatted"))).collect()
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        mine = sorted((r for r in out if r.conv_id == c), key=lambda r: r.example)
        ends = [i for i, x in enumerate(turns) if x[1] == "assistant" or i == len(turns) - 1]
        assert [r.n_turns for r in mine] == [i + 1 for i in ends]
        for r, i in zip(mine, ends, strict=True):
            assert [(p.role, p.text) for p in r.parsed] == [x[1:] for x in turns[: i + 1]]
            if turns[i][1] == "assistant":
                raw = r.formatted[r.loss_start : r.loss_start + r.loss_chars]
                assert raw.replace("\\g", ">").replace("\\l", "<").replace("\\b", "\\") == turns[i][2]
            else:
                assert r.loss_start is None and r.loss_chars is None
    assert chat.examples(frame.where("conv_id > 1000")).count() == 0


def water_filling(sizes, weights, cap=3):
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        level = left / sum(weights[i] for i in free)
        full = {i for i in free if weights[i] * level > cap * sizes[i]}
        if not full:
            for i in free:
                targets[i] = weights[i] * level
            break
        for i in full:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        free -= full
    return targets


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "big", "é", None]) if i % 3 else "big", " ".join("w" * rng.randint(0, 1) + "x" for _ in range(rng.randint(0, 60))), 0) for i in range(600)]
    rows += [(1000 + i, "tiny", "one", 0) for i in range(3)] + [(2000, "void", None, 0), (2001, "void", "  ", 0), (7, "a", "again and again", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    plan = mixing.allocate(frame).collect()
    assert len(plan) == len(rows)
    sizes = Counter()
    for _, s, t, _ in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    wanted = dict(zip(order, water_filling([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))]), strict=True))
    taken = Counter()
    for r in plan:
        assert abs(r.target - wanted[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken == r.size * r.copies <= 3 * r.size and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - wanted[s]) <= 60 for s in order)
    again = {(r.doc_id, r.size): r.positions for r in mixing.allocate(frame.orderBy(F.desc("doc_id"))).collect()}
    assert again == {(r.doc_id, r.size): r.positions for r in plan}
    row = mixing.curriculum(mixing.allocate(frame)).agg(F.count("*").alias("n"), F.sum("size").alias("w")).collect()[0]
    assert row.n == sum(r.copies for r in plan) and row.w == sum(taken.values())
    assert mixing.allocate(frame.where("doc_id < 0")).count() == 0


def test_positions_invert_the_schedule(spark):
    rows = spark.range(101).select((F.col("id") / 100.0).alias("u"))
    for schedule in (*mixing.SCHEDULES, ((0.0, 0.0), (0.5, 2.0), (1.0, 0.0))):
        total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False))

        def integral(t, schedule=schedule, total=total):
            out = 0.0
            for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False):
                x = min(max(t - t0, 0), t1 - t0)
                out += a * x + (b - a) / (t1 - t0) * x * x / 2
            return out / total

        for r in rows.select("u", mixing.position(F.col("u"), mixing._knots(schedule)).alias("t")).collect():
            assert abs(integral(r.t) - r.u) < 1e-9


def test_mixing_of_buckets(spark, monkeypatch):
    """Prefix sums over many buckets are those of one."""
    frame = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"))
    other = frame.union(frame.select(F.col("doc_id") + 1000, F.lit("t"), "text").where("doc_id < 1100"))
    one = sorted(mixing.allocate(other).collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    assert sorted(mixing.allocate(other).collect()) == one


def test_query_rows_come_in_training_order(spark, tmp_path):
    from veriloom.llm.queries import op10_mixing

    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice("abc")) for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = {r.doc_id: min(r.positions, default=2.0) for r in mixing.allocate(docs).collect()}
    got = op10_mixing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "copies", "first_position", "last_position"]
    assert [r.doc_id for r in got.collect()] == sorted(first, key=lambda i: (first[i], i))

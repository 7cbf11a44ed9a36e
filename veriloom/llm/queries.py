"""The registered queries of the corpus operators and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import chaining, chat, decontaminate, mixing, ngram_join, quality, secrets, suffix_dedup, topk, warc

ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, t=(85, 100))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("base_spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.listed(F.col("all_spans")).alias("spans"),
    )


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return topk.top_k(vectors.where("vec_id % 20 = 0"), vectors)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is read back from the examples: the turns from a conversation's longest one, the loss text by the masks."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise(F.lit(chat.ASSISTANT))
    two = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(probe).alias("text"))
    rows = chat.examples(turns.unionByName(two))
    loss = F.when(F.col("loss_start").isNotNull(), chat.unescape(F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_chars"))))
    whole = F.max_by("formatted", "n_turns")
    read = (
        rows.select("conv_id", "example", "n_turns", "formatted", loss.alias("loss"))
        .groupBy("conv_id")
        .agg(chat.parse(whole).alias("turns"), F.char_length(whole).cast("long").alias("formatted_chars"), F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"))
        .withColumn("loss", F.array_join(F.col("losses.loss"), ""))
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the resampling keeps, with their log weights and keys."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "log_weight", "key")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of each document, range-sorted by the position of its first copy in training (those not taken last); `mixing.curriculum` has a row for each copy."""
    plan = mixing.allocate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return mixing.in_training_order(plan).select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position", F.array_max("positions").alias("last_position"))


def _position_sql(share: str) -> str:
    """The schedules' integrals inverted, as `mixing.position` does it: one branch for each segment of each schedule."""
    solved = lambda s: f"{s['t']!r}::double + 2.0::double * {rest(s)} / ({s['a']!r}::double + {root(s)})"
    rest = lambda s: f"least(greatest({share} - {s['lo']!r}::double, 0.0::double), {s['hi'] - s['lo']!r}::double)"
    root = lambda s: f"sqrt(greatest({s['a'] * s['a']!r}::double + {2 * ((s['b'] - s['a']) / s['n'])!r}::double * {rest(s)}, 0.0::double))"
    out = []
    for i, schedule in enumerate(mixing.SCHEDULES):
        segments = mixing.segments(schedule)
        for s in segments:
            last = "" if s is segments[-1] else f" and {share} <= {s['hi']!r}::double"
            out.append(f"when (rank - 1) % {len(mixing.SCHEDULES)} = {i}{last} then least({solved(s)}, 1.0::double)")
    return f"case {' '.join(out)} end"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_ngram_join": op2_ngram_join,
    "op3_secret_scan": op3_secret_scan,
    "op4_top_k": op4_top_k,
    "op5_passages": op5_passages,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
}

ORACLE: dict[str, str] = {
    "op1_warc": """
        with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
        k as (select *, case when n >= 1000 then max(page_id) over (partition by html) end as keep from p)
        select page_id, cast(n as bigint) as payload_bytes, sha1(html) as payload_digest,
          case when keep is not null and page_id is distinct from keep then 'revisit' else 'response' end as record_type,
          case when keep is not null and page_id is distinct from keep then keep end as refers_to
        from k""",
    "op4_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
                   where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
              from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op8_decontaminate": rf"""
        with w as (select doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select cast(item_id as varchar) as item, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
        bw as (select distinct item, least(len(w), 13) as k, array_to_string(list_slice(w, i, i + 12), ' ') as win
               from (select item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) as i from b where len(w) > 0)),
        ks as (select distinct k from bw),
        dw as (select doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') as win
               from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from w, ks where len(w) >= k)),
        m as (select doc_id, i, dw.k, item from dw join bw on dw.k = bw.k and dw.win = bw.win),
        h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + k - 1)) as p from m) group by doc_id),
        it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from m) group by doc_id)
        select doc_id, coalesce(len(w), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
          coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) as contaminated
        from w left join h using (doc_id) left join it using (doc_id)""",
    "op10_mixing": r"""
        with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size, md5('mix:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
        s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rank from d group by source),
        w as (select *, [1, 2, 3][((rank - 1) % 3 + 1)::int] as weight, source_size * 3 as cap from s),
        l as (select *, (sum(source_size) over () - sum(cap) over (order by cap / weight, rank rows unbounded preceding) + cap)::double
                / (sum(weight) over (order by cap / weight, rank rows between current row and unbounded following))::double as level from w),
        t as (select *, least(cap::double, weight * first_value(level) over (order by case when level * weight <= cap then 0 else 1 end, cap / weight, rank)) as target from l),
        p as (select doc_id, size, source_size, target, rank, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes,
                sum(size) over (partition by d.source order by h, doc_id, size rows unbounded preceding) - size as start
              from d join t on d.source is not distinct from t.source),
        c as (select *, cast(case when size > 0 then passes + case when start + size / 2.0 <= target - passes * source_size and passes < 3 then 1 else 0 end else 0 end as int) as copies from p),
        m as (select *, case when copies > 0 then least((0.0::double + start::double + size::double / 2.0::double) / target, 1.0::double) end as one,
                case when copies > 0 then least(((copies - 1)::double * source_size::double + start::double + size::double / 2.0::double) / target, 1.0::double) end as last from c)
        select doc_id, size, source_size, target, cast(copies * size as bigint) as taken, copies, case when copies > 0 then """ + _position_sql("one") + """ end as first_position,
          case when copies > 0 then """ + _position_sql("last") + """ end as last_position
        from m""",
    "op7_chat_format": r"""
        with t as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        g as (
          select conv_id, count(*) as n_turns,
            string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
            coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as loss,
            sum(length(role) + length(text) + 16 + length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '>', ''))
              + length(role) - length(replace(role, chr(10), ''))) as n
          from t group by conv_id)
        select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(n as bigint) as formatted_chars
        from g""",
}

"""Queries against their DuckDB SQL on small odd tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__  # noqa: E402


@pytest.fixture
def same(spark, tmp_path):
    """Runs a query over tables given as SQL and asks that it returns what its SQL does."""

    def run(query: str, **tables: str) -> list[tuple]:
        db = duckdb.connect()
        for name, sql in tables.items():
            db.execute(f"create table {name} as {sql}")
            db.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
        want = db.execute(__spark_entry__.oracle_sql()[query]).fetchall()
        columns = [d[0] for d in db.description]
        got = [tuple(r) for r in __spark_entry__.queries()[query](spark, str(tmp_path)).select(*columns).collect()]
        key = lambda r: [(x is None, x) for x in r]
        assert sorted(got, key=key) == sorted(want, key=key)
        return want

    return run


def documents(*texts: str) -> str:
    rows = ", ".join(f"({i}, {t})" for i, t in enumerate(texts))
    return f"select doc_id::bigint as doc_id, text::varchar as text, 'en' as lang, 's' as source, length(text)::bigint as n_chars from (values {rows}) t(doc_id, text)"


def test_chunk_pages(same):
    blank_window = "repeat('a ', 6990) || repeat(chr(10), 20) || repeat(' ', 14100) || 'end'"
    same("chunk_pages", documents=documents("null", "'  '", blank_window, "chr(160) || 'abc' || chr(160)", "repeat('ab' || chr(8195) || 'c. ', 4000)", "repeat('abc' || chr(160), 8000)", "repeat('wörd' || chr(13) || chr(10), 5000)", "repeat('x', 30000)"))


def test_page_text_stats(same):
    odd = documents("null", "''", "'   '", "chr(10)", "repeat('é', 600)")
    same("page_text_stats", documents=f"{odd} union all select 1500000000, 'far', 'en', 's', 3")


SUPPLIERS = "select i::bigint as s_suppkey, 'S' as s_name, (i % 7)::int as s_nationkey, (case when i % 5 = 0 then 0.5 else i % 4 end * 1000)::double as s_acctbal from range(60) t(i)"


def test_pairs_of_values(same, spark, tmp_path):
    """Also in several blocks; equal pairs are told apart without an aggregate over all of them."""
    import __spark_entry__
    from veriloom import queries
    from veriloom.operators import pairs

    want = same("unit_conflict_pairs", supplier=SUPPLIERS)
    same("equal_value_pairs", supplier=SUPPLIERS)
    facts = queries.supplier_facts(spark, str(tmp_path))
    found = pairs.unit_conflict_pairs(facts, size=4)
    assert sorted((int(r.f1.id), int(r.f2.id)) for r in found.collect()) == sorted(want)
    assert "lo" in found._jdf.queryExecution().optimizedPlan().toString()
    plan = __spark_entry__.queries()["equal_value_pairs"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_similarity_scores_use_all_tasks(spark):
    from veriloom import queries

    assert "Repartition" in queries.similarity_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()

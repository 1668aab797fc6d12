"""Entry points the driver calls."""

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
SAMPLE = ["flt1_exclude_paths", "chk1_word_chunks", "emb5_modal_dim", "ret1_topk", "cnv9_full_prompt", "wik5_section_tree",
          "drv1_budget_pack", "snk4_markdown", "gen10_fold_deltas"]


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["query_id", "context"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages", "events", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = e.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({e.oracle_sql()[name]})").fetchall()

    def norm(rows):
        return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)

    assert norm(df.select(*cols).collect()) == norm(want)

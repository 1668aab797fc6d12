"""Answers of long conversations do not share a key with those of the next conversation."""

from repolore.plans.catalog import QUERIES


def test_turn_1001_and_the_next_conversation(spark, tmp_path):
    rows = [(9, 1001, "assistant", "the end"), (10, 1, "assistant", "a summary")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r.conv_id, r.iteration, r.type, r.content.split("\n")[-1]) for r in QUERIES["str3_live_stages"](spark, str(tmp_path)).collect())
    assert got == [(9, 501, "conclusion", "the end")]

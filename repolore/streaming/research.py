"""Research in rounds: ask, judge the answer, ask to continue, at most five times."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from repolore import constants as C
from repolore.operators import converse, derive, generate
from repolore.session import cut_lineage
from repolore.streaming.assemble import time_mode


def run_rounds(messages: DataFrame, make_prompts: Callable[[DataFrame], DataFrame], make_generator) -> DataFrame:
    """Answers (conv_id, iteration, phase, content, error, complete) of all research conversations.

    ``make_prompts`` maps request state to (conv_id, prompt). Each round works on the open conversations only and is
    checkpointed, so a model is never asked twice for the same round.
    """
    rounds = []
    current = messages.select("conv_id", "turn", "role", "content")
    for _ in range(C.MAX_RESEARCH_ITERATIONS):
        state = converse.request_state(current).where("is_research AND error_code IS NULL")
        asked = state.select("conv_id", "iteration", "phase", "n_messages").join(make_prompts(state), "conv_id")
        answered = generate.generate(asked, make_generator)
        text = derive.force_conclusion(F.coalesce("response", F.lit("")), F.col("iteration"))
        failed = F.col("error").isNotNull()
        closed = failed | (F.col("iteration") >= C.MAX_RESEARCH_ITERATIONS) | derive.research_complete(F.col("content"))
        done = cut_lineage(
            answered.withColumn("content", F.when(failed, generate.reply_or_message(F.col("response"), F.col("error"))).otherwise(text))
            .withColumn("complete", closed)
            .select("conv_id", "iteration", "phase", "n_messages", "content", "error", "complete")
        )
        rounds.append(done.drop("n_messages"))
        still = done.where("NOT complete")
        if still.isEmpty():
            break
        added = still.select(
            "conv_id",
            F.inline(
                F.array(
                    F.struct(F.col("n_messages").alias("turn"), F.lit("assistant").alias("role"), F.col("content")),
                    F.struct((F.col("n_messages") + 1).alias("turn"), F.lit("user").alias("role"),
                             F.lit(C.CONTINUE_MESSAGE).alias("content")),
                )
            ),
        )
        current = cut_lineage(
            current.join(still.select("conv_id"), "conv_id", "left_semi").unionByName(added)
        )
    return reduce(DataFrame.unionByName, rounds)


NEXT_SCHEMA = "conv_id bigint, seq bigint, iteration bigint, complete boolean, next_message string"


class RoundTracker(StatefulProcessor):
    """Judged answers (conv_id, seq, done) to the next step. State: positions counted (five at most) and
    whether it is over. A late answer counts as the next iteration; only a repeated position is dropped."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("round", "seen string, closed boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        text, closed = self.state.get() if self.state.exists() else ("", False)
        seen = text.split(",") if text else []
        pdf = pd.concat(list(rows), ignore_index=True).drop_duplicates("seq").sort_values("seq")
        out = []
        for seq, done in pdf[["seq", "done"]].itertuples(index=False):
            if closed or str(seq) in seen:
                continue
            seen.append(str(seq))
            closed = bool(done) or len(seen) >= C.MAX_RESEARCH_ITERATIONS
            out.append((key[0], int(seq), len(seen), closed, None if closed else C.CONTINUE_MESSAGE))
        self.state.update((",".join(seen), closed))
        yield pd.DataFrame(out, columns=["conv_id", "seq", "iteration", "complete", "next_message"]).astype(
            {"conv_id": "int64", "seq": "int64", "iteration": "int64", "complete": "bool"}
        )

    def close(self) -> None:
        pass


def next_steps(answers: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Stream of answers (conv_id, seq, content) to the message that continues each conversation."""
    judged = answers.select("conv_id", "seq", derive.research_complete(F.col("content")).alias("done"))
    return judged.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=RoundTracker(ttl_ms), outputStructType=NEXT_SCHEMA, outputMode="append",
        timeMode=time_mode(ttl_ms),
    )

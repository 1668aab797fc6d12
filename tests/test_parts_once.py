"""What the parts of long texts are made from is worked out once."""

from repolore.operators.ordered import whole_texts


def test_parts_are_worked_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(k, i, None if i == 3 else f"{k}-{i}") for k in range(5) for i in range(20)]
    df = spark.createDataFrame(rows, "k bigint, i bigint, t string").repartition(3)
    for cell, blocks in ((10_000, {0}), (60, {0, 1})):
        made.value = 0
        got = whole_texts(df.mapInArrow(run, df.schema), ["k"], ["i"], "t", sep=",", cell_chars=cell, block_chars=50).collect()
        assert made.value == len(rows) and blocks <= {r.block for r in got}
        for k in range(5):
            assert "".join(r.text for r in sorted(got, key=lambda r: r.block) if r.k == k) == ",".join(f"{k}-{i}" for i in range(20) if i != 3)

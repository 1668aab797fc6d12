"""Workshop steps: the text of a step is worked out once, and null or bare texts pass as before."""

from pyspark.sql import functions as F

from repolore.functions import text as X
from repolore.operators import derive


def test_a_step_names_the_one_before_it_once(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("c")).select(derive.workshop(F.col("c")).alias("c"))
    whole = plan._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("Exercise [0-9]+") == 1 and whole.count("(?i)^```") == 1 and whole.count("(?m)^## (") == 1


def test_steps_on_odd_texts(spark):
    texts = [None, "", "# T", "## A", "# T\n## A\nx", "```markdown\n# T\n## Exercise 1: a\nb\n## Final Project", "# T\n## Contents\n## Exercise 2: b\n", "# é\nx ## A\n## Exercise 1: ü\n## Final Project\nend```"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").coalesce(1)
    got = [r.c for r in df.select("i", derive.workshop(F.col("c")).alias("c")).orderBy("i").collect()]
    toc = "## Table of Contents\n\n%s\n"
    one = '<div style="text-align: right; font-size: 0.85em; color: #666;">\nExercise 1 of 1 | Estimated time: 5 minutes\n</div>\n\n'
    last = '<div style="text-align: right; font-size: 0.85em; color: #666;">\nEstimated time: 20-30 minutes | Combines concepts from all exercises\n</div>\n\n'
    assert got[:5] == [None, "", "# T", "## A", "# T\n" + toc % "- [A](#a)\n" + "## A\nx"]
    assert got[5] == "# T\n" + toc % "- [Exercise 1: a](#exercise-1-a)\n- [Final Project](#final-project)\n" + "## Exercise 1: a\n" + one + "b\n## Final Project"
    assert got[6] == "# T\n## Contents\n## Exercise 2: b\n" + one
    assert got[7] == "# é\nx " + toc % "- [Exercise 1: ü](#exercise-1-)\n- [Final Project](#final-project)\n" + "## A\n## Exercise 1: ü\n" + one + "## Final Project\n" + last + "end"
    assert [r.x for r in df.select(X.once(F.col("c"), F.length).alias("x")).collect()] == [None if t is None else len(t) for t in texts]

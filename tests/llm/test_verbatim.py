"""Verbatim benchmark text is found whatever stands before it, and although one slot of it was changed."""

from repolore.llm import decontaminate

DDL = "doc_id long, text string"


def found(spark, texts, items, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), DDL)
    out = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), **more)
    return sorted((r.doc_id, r.item_id, r.n_matched, r.first_word) for r in out.collect())


def test_one_changed_name_keeps_the_other_windows(spark):
    words = [f"w{i}x" for i in range(60)]
    words[10] = words[40] = "Anna"
    doc = list(words)
    doc[40] = "Maria"
    # windows that hold word 40 (starts 33 to 40) are dropped: words 0 to 39 and 41 to 59 are left
    assert found(spark, ["pre " + " ".join(doc)], [(1, " ".join(words))]) == [(0, 1, 59, 1)]
    # ten names of which nine are exchanged alike: only the windows with the tenth are dropped
    words = [f"w{i}x" if i % 9 else "Anna" for i in range(1, 91)]
    doc = ["Lena" if w == "Anna" else w for w in words]
    doc[-1] = "Vera"
    assert found(spark, [" ".join(doc)], [(1, " ".join(words))]) == [(0, 1, 89, 0)]


def test_first_word_counts_alike_wherever_it_stands(spark):
    items = [(1, "What is the capital of France now?"), (2, "days until the harvest of winter wheat"), (3, "Then Anna walked slowly along the quiet river bank")]
    texts = ["Question 5\nWhat is the capital of France now?", "What is the capital of France now?", "in 12 days until the harvest of winter wheat", "days until the harvest of winter wheat", "Anna walked slowly along the quiet river bank here", "Who is the capital of France now?"]
    assert [x[:2] for x in found(spark, texts, items, width=8)] == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3)]


def test_windows_of_placeholders_count_word_for_word(spark):
    item = "the sum of these numbers is wanted by us " + " ".join(str(i) for i in range(100, 160))
    assert found(spark, ["see " + item], [(1, item)]) == [(0, 1, 69, 1)]

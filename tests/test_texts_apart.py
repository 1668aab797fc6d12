"""Hits take their texts from chunks that no vector was joined to."""

from repolore.plans import flagship


def test_vectors_need_no_texts(spark):
    queries = spark.createDataFrame([(1, "r", [1.0, 0.0]), (2, "s", [0.0, 1.0])], "query_id bigint, repo string, vector array<float>")
    vectors = spark.createDataFrame([(10, "r", [1.0, 0.0]), (11, "r", [0.5, 0.0]), (12, "s", [0.0, 2.0])], "chunk_id bigint, repo string, vector array<float>")
    texts = spark.createDataFrame([(i, f"f{i}", f"text {i}") for i in range(8, 14)], "chunk_id bigint, file_path string, text string")
    got = flagship.hits(queries, vectors, texts=texts).select("query_id", "rank", "chunk_id", "file_path", "text").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 10, "f10", "text 10"), (1, 2, 11, "f11", "text 11"), (2, 1, 12, "f12", "text 12")]
    whole = flagship.hits(queries, vectors.join(texts, "chunk_id")).select("query_id", "rank", "chunk_id", "file_path", "text").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, got))

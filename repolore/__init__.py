"""Repository knowledge as Spark jobs: corpus, chunks, vectors, retrieval, prompts, wikis, exports."""

__version__ = "0.1.0"

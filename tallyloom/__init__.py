"""A Spark-first engine for building, auditing and scoring table question-answering data."""

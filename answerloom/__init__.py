"""Spark data operators for answer grading, sample voting, rollout statistics,
table profiling, vector search and training-set assembly."""

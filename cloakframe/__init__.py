"""Reversible pseudonymization of tables on Spark, and training-data operators in ``llm``."""

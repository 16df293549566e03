"""Training-data operators: ten corpus operators and the stages of the corpus pipeline.

Nothing outside this folder imports it; the queries and their SQL are in ``queries``.
"""

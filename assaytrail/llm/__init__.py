"""Operations of a training-data pipeline: ten operators, their queries and their SQL.

Nothing outside this folder imports it, but for the guarded lookup in ``__spark_entry__``.
"""

"""Operations of a training-data pipeline, as Spark jobs.

Nothing outside this folder imports it; `queries` holds the thin registered
queries, every other module one operator or what several of them share.
"""

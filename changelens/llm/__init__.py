"""Operations of a training-data pipeline, each a composition of Spark jobs.

Nothing outside this subpackage imports it.
"""

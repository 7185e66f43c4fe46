"""Streams.

The relational operators are expressions on DataFrames, so that filters,
projections and joins with static tables apply to a streaming DataFrame as they
stand: ``Table(spark.readStream...).filter_public(...)``.  There is no stateful
operator here.
"""

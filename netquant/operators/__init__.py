"""Operators: functions from DataFrames to DataFrames.

Every operator takes ``by``, extra key columns such as a run id, so that a batch of runs is one
job: the keys take part in each grouping and join.
"""

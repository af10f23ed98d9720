"""Air-quality source detection and enforcement analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames; ``city`` is an ordinary column, so
one job covers any number of cities.
"""

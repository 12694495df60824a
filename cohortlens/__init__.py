"""Product analytics over partitioned event logs, as lazy PySpark DataFrames.

``sources``    table, partition, snapshot and CSV readers and writers
``functions``  column expressions: time arithmetic, grades, bins, measures
``operators``  DataFrame -> DataFrame building blocks that hold up under skew
``plans``      the composed analytics jobs
``catalog``    every query over the driver tables, with its SQL counterpart
"""

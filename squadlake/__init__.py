"""Spark-native medallion analytics for athlete-monitoring feeds.

Layers, bottom up:

* ``functions``  Column -> Column rules (units, scales, names, local time, flags)
* ``operators``  DataFrame -> DataFrame building blocks (dedup, grids, as-of, identity, quality, SCD-2)
* ``sources``    landing raw JSON, seeds, rosters, versioned tables
* ``streaming``  incremental landing with checkpointed offsets
* ``plans``      the domain: staging, silver, dimensions, facts, weekly mart, reports
* ``catalog``    the operators run over the driver's tables, each with an SQL oracle
"""

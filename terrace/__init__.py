"""terrace: a medallion lakehouse toolkit on the Spark DataFrame and Structured Streaming APIs.

Layers, from small to large:

* ``functions``  column expressions
* ``spec``       declarative table, rule, lookup and measure specifications
* ``operators``  DataFrame to DataFrame operators driven by those specifications
* ``sources`` / ``sinks``  incremental file ingest, event sources, snapshot upserts, layout
* ``streaming``  event parsing, deduplication, windows, stream runners
* ``plans``      the bronze, silver, gold and event jobs
* ``flights``    the on-time-performance model expressed as specifications
"""

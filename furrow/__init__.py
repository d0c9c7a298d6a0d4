"""furrow: agricultural weather analytics on Spark DataFrames.

Sub-packages
------------
sources    payload readers (map / arrays / regular series / wide), partitioned
           scans, CSV (with preamble), XML catalogue, JDBC option,
           parameterised SQL, inline reference tables
sinks      partitioned writes (dynamic overwrite, year / month / day / yyyymm),
           bucketed tables, keyed upserts, schema alignment, export
functions  Column rules: cleaning, dates, agronomy (ET0, NDVI, LST), text, JSON
operators  DataFrame -> DataFrame building blocks: reshape, segmented-scan
           fills (day / turn-block / data-derived range chunks), dedup,
           quality reports, merges, dense keys, search, normaliser pipelines,
           text profile, salted joins
plans      analytic queries and flows: planting window, yearly backfill,
           conversation logs, catalogue statistics, and the driver-table
           proxies with their DuckDB oracle SQL
streaming  incremental file-driven upsert (Structured Streaming, foreachBatch)
"""

__version__ = "0.1.0"

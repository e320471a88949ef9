"""Feature engineering and forecasting on Spark DataFrames.

``functions``   column expressions (parsing, recoding, ratios)
``operators``   DataFrame -> DataFrame building blocks
``sources``     CSV / parquet scans and sinks
``models``      Spark ML estimators, validation, ensembles
``plans``       whole feature tables and forecasts built from the above
``catalog``     the registered queries with their SQL counterparts
"""

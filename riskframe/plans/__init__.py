"""Bindings of the operators to concrete tables (the driver's test tables).

Each plan module registers ``key -> (spark_fn(spark, sf_dir), oracle_sql)``;
``riskframe.plans.catalog`` imports them all.
"""

"""Delivery-reliability analytics on e-commerce order data, as Spark DataFrames.

``sources``   declared schemas, CSV ingest, Parquet tables, published views
``functions`` column expressions: exact rounding, day differences, bands, labels
``operators`` DataFrame operators: latest row per key, distributed NTILE, shares
``plans``     quality checks, the order-level fact, its rollups and the findings
"""

"""Shipment data from raw files to reporting tables, as Spark DataFrame operators."""

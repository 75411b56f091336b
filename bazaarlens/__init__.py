"""Retail-offer analytics expressed as Spark DataFrame operators."""

"""Retail price intelligence on Spark: matching, pricing and market analytics as DataFrame operators."""

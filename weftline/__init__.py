"""Weftline: corpus curation and evaluation operators written for PySpark."""

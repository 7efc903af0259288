"""Distributed text redaction and document analytics on PySpark."""

"""Docketlake: regulatory-document analytics as Spark DataFrame operators."""

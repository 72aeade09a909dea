"""Millrace: a Spark-first analytics engine with embedded-SQL semantics."""

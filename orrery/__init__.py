"""A Spark-first analytics engine for typed property graphs, text corpora and event logs."""

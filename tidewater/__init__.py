"""Dataflow-fact analytics expressed with Spark DataFrames."""

"""Incremental evaluation over streams of new facts."""

"""Readers and writers of program facts and declarative models."""

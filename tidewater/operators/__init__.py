"""Relational building blocks: paths, lattices, graph closures, rules."""

"""Lattika: a cube, search and similarity engine expressed as Spark plans."""

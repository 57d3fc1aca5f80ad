"""Readers, writers and the bindings of the driver tables."""

"""Bindings of the operators to the driver tables, each with its SQL twin."""

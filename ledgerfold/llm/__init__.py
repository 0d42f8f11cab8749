"""Operators for training text: packing, mixing and sentence units. Nothing outside this package imports it."""

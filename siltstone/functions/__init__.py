"""Column expressions: everything that needs no document tree, as native functions."""

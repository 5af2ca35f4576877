"""Scalar functions, as ``Column -> Column`` builders over native expressions with a vectorised slow path."""

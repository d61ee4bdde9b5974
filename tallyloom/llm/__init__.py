"""Operators for preparing training text: one module a problem, p1 to p8."""

"""Scalar functions on columns: exact rates and rounding, label orders, keys and text."""

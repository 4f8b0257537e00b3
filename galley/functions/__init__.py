"""Scalar functions: plain Python functions from columns to a column, built-in expressions only."""

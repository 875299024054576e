"""Incremental forms of the bookkeeping operators."""

"""Operators for preparing a training corpus."""

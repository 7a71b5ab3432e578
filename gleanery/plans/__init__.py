"""Whole-job compositions of the operators."""

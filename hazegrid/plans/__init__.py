"""Compositions of operators: feature panel, detection chain, full pipeline."""

"""Readers for landed feeds and writers for the tables the pipeline produces."""

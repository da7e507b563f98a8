"""Inkwell: document cleaning over DataFrames of documents."""

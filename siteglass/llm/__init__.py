"""Operators for large text corpora: one module per operator, registered through :mod:`siteglass.llm.queries`."""

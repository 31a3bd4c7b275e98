"""Training-data operators: one module per operator, queries in :mod:`stratograph.llm.queries`."""

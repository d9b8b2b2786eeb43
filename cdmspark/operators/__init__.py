"""Operators: profiling, conforming, mapping documents, retrieval, proposals, workflow, checks."""

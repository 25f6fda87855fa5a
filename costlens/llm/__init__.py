"""Operators for preparing large text corpora (training-data pipelines).

Nothing outside this subpackage imports it; the entry module adds its queries
only when it can be imported."""

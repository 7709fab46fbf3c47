"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered query of each operator together with its SQL counterpart.
"""

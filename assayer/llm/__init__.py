"""Operators for training-data corpora.

Nothing else in the library imports this subpackage.  ``queries`` registers one
query per operator; every operator module keeps its own, more general interface.
"""

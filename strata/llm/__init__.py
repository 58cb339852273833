"""Operators for preparing language-model training data.

One module per operator; ``queries.py`` registers ``opN_<name>`` and the
corpus pipeline.  Nothing outside this package imports it.
"""

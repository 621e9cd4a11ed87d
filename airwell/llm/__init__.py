"""Operators for building language-model training corpora on Spark.

Thirteen operators, one module each; their registered queries are in ``queries``.
Nothing outside this package imports it.
"""

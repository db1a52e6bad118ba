"""Operators for preparing large text corpora for language-model training.

Ten operators, one module each, plus ``queries`` with the registered queries. Nothing outside this
subpackage imports it.
"""

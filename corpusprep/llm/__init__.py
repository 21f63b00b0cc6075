"""Operators for preparing language-model training corpora.

Ten operators, each a function from DataFrames to a DataFrame, plus the registered queries
(``registry``). Nothing outside this package imports it; it may import general helpers.
"""

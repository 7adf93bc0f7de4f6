"""Operators for preparing training data: text, vectors and conversations.

Nothing outside this folder imports it. Each operator is a function from
DataFrames to a DataFrame; ``queries.py`` registers one query per operator.
"""

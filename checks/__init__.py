"""Queries over the given tables, each with the SQL that states its result.

``standins`` derives the inputs of the operators (files, tokens, comments, predictions,
pairs, a repository catalog) from those tables; the other modules hold the queries.
"""

"""Operators of a training-data pipeline over the tables documents, pages, embeddings and labels.

One module an operator; `queries` registers them. Nothing else in the library imports this subpackage.
"""

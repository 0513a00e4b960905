"""Operators of a training-data pipeline over text and vector tables.

One module per operator; ``registry`` lists the registered queries and their
SQL.  Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""

"""Training-data pipeline operators.

One module per operator, ``queries.py`` with the registered queries and their
SQL.  Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

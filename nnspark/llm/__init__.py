"""Operators of a training-data pipeline (toxicity, near-duplicates, licences, ...).

Self-contained: nothing else in the library imports this subpackage.  Each
operator module has its own DataFrame interface; ``queries.py`` holds the thin
registered queries and ``oracle.py`` their SQL where SQL can express them.
"""

"""Operators for large training corpora.

Self-contained: the rest of the library never imports this subpackage, and it can be deleted without
effect on the remaining queries.  Every operator takes a DataFrame, selects the columns it needs by name
(so that extra or clashing columns do no harm) and returns a DataFrame.
"""

"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; :mod:`spanloom.llm.queries` derives from them the
registered ``opN_*`` queries.
"""

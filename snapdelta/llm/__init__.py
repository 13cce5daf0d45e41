"""Operators of a training-data pipeline: ten corpus operators over `documents`.

Nothing outside this subpackage imports it. `registry.queries()` and
`registry.oracle_sql()` are what the entry module adds when it is present.
"""

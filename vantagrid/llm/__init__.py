"""Operators for preparing very large text corpora, each one a Spark job.

Nothing outside this subpackage imports it.  ``registry`` lists the queries
and the SQL that the entry module adds when the subpackage is present.
"""

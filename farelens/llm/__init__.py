"""Operators for preparing training corpora, their queries and the SQL they are checked against."""

"""Operators of a training-data pipeline (tokenising, extraction, filtering, dedup, scoring).

Nothing outside this subpackage imports it; ``queries`` and ``oracle`` hold the
registered queries and their SQL.
"""

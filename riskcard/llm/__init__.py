"""Training-data operators: dedup, filtering, search, archives, mixing and sharding.

Nothing outside this folder imports it.  ``queries.py`` registers one query per
operator, ``oracle.py`` holds the DuckDB SQL for those SQL can express.
"""

"""Every registered query of the library, with the SQL that must give the same rows."""

from __future__ import annotations

from functools import wraps

from cutline.session import sound_unions

from . import curve_queries, file_queries, ledger_queries, long_queries, segment_queries, stat_queries, stream_queries, text_queries

MODULES = (stat_queries, segment_queries, long_queries, curve_queries, ledger_queries, text_queries, file_queries, stream_queries)


def _sound(query):
    @wraps(query)
    def run(spark, sf_dir):
        sound_unions(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _sound(query) for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}

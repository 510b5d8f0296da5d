"""Training-data operators: de-duplication, packing, privacy, extraction, archives, scoring, mixing, search.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the registered queries are in :mod:`tessera.llm.queries`.
"""

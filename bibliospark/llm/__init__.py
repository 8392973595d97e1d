"""Training-data operators over `documents`, `pages` and `benchmark`.

One module per operator; `queries.py` registers the thin `opN_<name>` queries.
Nothing outside this package (but `__spark_entry__.py`, if it can be imported,
and `corpus_pipeline.py`) imports it.
"""

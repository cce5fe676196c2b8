"""Training-data pipeline operators.

Each module holds one operator with a general interface and the thin query
``opN_<name>(spark, sf_dir)`` that applies it to a whole table.  ``QUERIES``
and ``ORACLES`` in ``queries`` list them for the entry point.
"""

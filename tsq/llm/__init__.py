"""Training-data pipeline operators (ten methods over text tables).

Nothing else in the library imports this package; ``__spark_entry__`` adds
its queries when it can be imported.
"""

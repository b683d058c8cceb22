"""Training-data operators: one module per operator, ``queries.py`` for the named queries.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""

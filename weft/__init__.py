"""weft: a PySpark-native engine for property graphs drawn from literature.

Everything is a DataFrame in and a DataFrame out.  See README.md for the map of
operators; ``__spark_entry__.py`` lists the runnable queries.
"""

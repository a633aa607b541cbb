"""A Spark engine over versioned, content-addressed namespaces.

Everything is a DataFrame: snapshots of a bucket are rows of ``inodes``,
``dirents`` and ``chunk_refs``; operators take and return DataFrames and leave
physical planning to Catalyst and adaptive execution.
"""

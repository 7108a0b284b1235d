"""Web search analytics on Spark: pages in, a ranked and searchable corpus out."""

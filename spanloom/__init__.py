"""A corpus search engine on Spark: token-level queries, metadata filters,
concordances and statistics over annotated text and speech."""

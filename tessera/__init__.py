"""tessera: an analytics engine written on Spark's DataFrame, SQL and Structured Streaming APIs."""

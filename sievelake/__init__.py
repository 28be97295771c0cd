"""Analytics over semi-structured postings, documents and event streams, as Spark DataFrame operators."""

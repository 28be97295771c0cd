"""Column helpers: text normalisation, URLs, similarity, salaries. All are built-in expressions unless named ``*_udf``."""

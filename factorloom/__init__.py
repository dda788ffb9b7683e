"""Panel research on Spark: long (date, symbol) tables, declarative operators."""

"""Analytics over documents, line-oriented results and relational tables, as PySpark DataFrame programs."""

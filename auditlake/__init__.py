"""Analytics over many source-code repositories or text corpora, on Spark."""

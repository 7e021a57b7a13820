"""Long-term-memory analytics on Spark: tables of dated text to graphs, states, retrieval and evaluation."""

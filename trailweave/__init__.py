"""Graph analytics over research papers, and text preparation, as Spark DataFrame operations."""

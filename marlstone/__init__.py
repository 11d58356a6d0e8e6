"""marlstone: retrieval, knowledge-graph and corpus analytics as composable PySpark DataFrame transformations."""

"""docloom: document, table and retrieval analytics as PySpark DataFrame transformations."""

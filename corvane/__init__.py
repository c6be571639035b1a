"""corvane: retrieval, dialog analytics and corpus integrity as Spark DataFrame transformations."""

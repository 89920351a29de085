"""Similarity retrieval and entity resolution over image-derived catalogues, on PySpark."""

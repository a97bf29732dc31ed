"""Tessera: sparse-matrix relational algebra and corpus analytics on PySpark."""

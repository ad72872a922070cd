"""urlmill: URL, page, archive and corpus analytics as declarative PySpark."""

"""Data quality and portfolio analysis of one wide fact table ("the book"), written as Spark jobs."""
from bookdq.book import Book, BookSpec, Measures, UnknownColumnError

__all__ = ["Book", "BookSpec", "Measures", "UnknownColumnError"]

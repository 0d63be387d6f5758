"""PySpark operators that turn web pages, search hits and scores into verified tables."""

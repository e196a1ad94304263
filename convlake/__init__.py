"""Spark jobs over collections of captured chat pages, conversations and documents."""

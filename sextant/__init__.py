"""Sextant: search, citation graphs and catalogue analytics over document collections, as Spark plans."""

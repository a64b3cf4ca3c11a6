"""Tessera: analytics over knowledge corpora, expressed as Spark DataFrames."""

"""Viewing-history analytics and corpus operators on Spark DataFrames."""

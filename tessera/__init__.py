"""Declarative record extraction over tables of web pages and text, as Spark DataFrames."""

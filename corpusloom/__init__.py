"""Knowledge-corpus analytics on Spark DataFrames."""

from corpusloom.corpus import Corpus

__all__ = ["Corpus"]

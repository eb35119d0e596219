"""corkscrew: a Spark-native toolkit for free-text records with a category.

Cleans review-like tables, turns text into lexicon flags and TF-IDF
weights, joins requests to their nearest records with attribute filters
and a fallback, audits lookup tables and vocabularies, and selects,
refits and serves Spark ML models.
"""

__version__ = "0.1.0"

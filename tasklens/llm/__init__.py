"""Training-data operators: search, near-duplicates, language, URL rules,
chat repair, packing, substring deduplication, decontamination, toxicity and
license scans.

Nothing else in the library imports this subpackage. Each module keeps the
general operator; ``queries.py`` holds the thin registered queries.
"""

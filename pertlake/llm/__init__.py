"""Training-data operators: dedup, filters, classifiers, packing and token output.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""

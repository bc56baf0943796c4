"""Training-data operators: token counts, chat formatting, deduplication,
classifiers, decontamination, sanitisation, packing and vector search.

Nothing outside this subpackage imports it.
"""

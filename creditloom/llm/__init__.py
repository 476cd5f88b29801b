"""Training-data operators: packing, language, toxicity, deduplication, decontamination and URL filters.

Nothing outside this package imports it; ``creditloom.llm.catalog`` lists its queries and their SQL.
"""

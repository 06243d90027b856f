"""Training-data operators: quality, sharding, toxicity, mixing, tokens, deduplication, packing, media, language model.

Nothing outside this package imports it; its queries are in ``weftline.llm.queries``.
"""

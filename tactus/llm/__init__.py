"""Training-data operators: quality rules, tokenisation, deduplication, search, sharding, mixing, PII, chat formatting.

Nothing outside this folder imports it; ``registry`` lists its queries for the driver.
"""

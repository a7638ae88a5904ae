"""Training-data operators: near-dedup, tokenization, scans, mixing, models.

Nothing outside this folder imports it; the registry in ``__spark_entry__``
adds its queries only when the folder is there.
"""

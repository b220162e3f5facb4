"""Training-data operators: quality scores, page text, URL rules, shards, web archives,
decontamination, licence scans, BPE, SimHash and embedding near-duplicates.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""

"""flipframe: counterfactual-text data work expressed as Spark DataFrame jobs.

Sub-packages
------------
sources    scans and sinks (TSV, headerless text, folder-labelled files, fold store, metrics table)
functions  column expressions (tokeniser, HTML strip, prompt templates, hash order, labels)
operators  DataFrame -> DataFrame operators (sampling, pairing, candidates, n-gram metrics,
           edit distances, aggregates, corpus packing, model plug-ins)
plans      end-to-end jobs (metric suite, augmentation report) and the query catalogue
streaming  incremental evaluation of candidate files as they land in a folder
"""

__all__ = ["session"]

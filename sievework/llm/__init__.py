"""Training-data operators: each module holds one operator, `queries` registers them.

Nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""

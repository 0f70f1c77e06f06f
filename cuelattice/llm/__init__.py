"""Training-data operators: ten self-contained stages for building language-model corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

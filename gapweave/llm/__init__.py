"""Training-data operators: classifiers, de-duplication, media, packing and token files.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

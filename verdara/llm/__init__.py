"""Training-data operators.

Nothing outside this folder (and corpus_pipeline.py) imports it; the registry in
``queries`` is added to the driver contract only when the folder is present.
"""

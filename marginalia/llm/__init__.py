"""Training-data operators: one module for each, with its query beside it.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds
``llm.registry`` when the folder is there.
"""

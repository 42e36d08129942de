"""Training-data operators: ten corpus stages that stand beside the vocabulary engine.

Nothing outside this package imports it; `__spark_entry__.py` adds its queries when it is present.
"""

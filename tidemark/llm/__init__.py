"""Training-data operators: one module for each operator, registered by ``registry``.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""

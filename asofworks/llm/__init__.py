"""Training-data operators: the ten corpus operators and the helpers they share.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""

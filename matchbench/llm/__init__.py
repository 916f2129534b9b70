"""Training-data operators (mixing, near duplicates, decontamination, ...).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when it can be imported.
"""

"""Training-data operators: thirteen corpus-preparation methods and their queries.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries when it is present.
"""

"""Training-data operators over the document, page and benchmark tables.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries when it is there.
"""

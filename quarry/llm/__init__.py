"""Training-data operators: ten corpus operators over ``documents`` and
``embeddings`` plus their registered queries (``queries.py``). Nothing else in
the library imports this subpackage."""

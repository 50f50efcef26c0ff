"""Training-data operators: ten self-contained operators over text and vectors.

Nothing else in the library imports this package; ``registry`` lists its queries.
"""

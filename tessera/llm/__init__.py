"""Operations for training-data pipelines over text corpora.

Nothing else in the library imports this package.  Each module holds one
operator; ``queries`` registers them; ``shared`` and ``arrowtext`` hold what
several of them use.
"""

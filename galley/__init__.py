"""Text quality checks over a corpus of documents, as Spark DataFrames.

One document is one row.  Everything that belongs to a single document is
worked out inside its row with array functions, so no shuffle is needed for
it; shuffles happen only where words meet words across rows.
"""

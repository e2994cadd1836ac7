"""Operations of a training-data pipeline: ten operators over documents, pages and embeddings.

Nothing else in the library imports this subpackage.  Every operator takes DataFrames, selects only
the columns it needs (so extra columns, whatever their names, never clash) and returns a DataFrame.
"""

"""Operations of a training-data pipeline over document tables.

Every operator takes DataFrames and column names, returns a DataFrame and keeps rows on executors. Operators whose work
is plain column logic stay in Spark SQL; the others run Arrow batches through numpy. Nothing outside this folder
(besides ``corpus_pipeline.py``) imports it.
"""

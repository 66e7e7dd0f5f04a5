"""flowmetrics: warehouse and campaign analytics as Spark DataFrame operations.

Sub-packages
------------
functions   Column -> Column expressions (time, labels, scores)
operators   DataFrame -> DataFrame operations
sources     readers and sinks
plans       the composed flows (picking times, campaign life cycle, adjusted scores)

Functions take and return DataFrames; shared intermediate tables are written while a plan is built (:func:`session.settle`). Missing values are NULL, never NaN.
Timestamps are compared in UTC: call :func:`flowmetrics.session.configure` once per session.
"""

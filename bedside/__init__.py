"""Analytics over sparse, irregularly recorded patient time series on Spark.

A *chart* is a DataFrame with one row per patient and hour: ``pid``, ``t``
(0, 1, 2 ... per patient), one nullable double column per measurement and an
integer outcome ``y``.
"""

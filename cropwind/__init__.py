"""Weekly climate, price and supply panels as Spark jobs.

Every function takes DataFrames and returns a DataFrame.  Nothing here holds a
series in Python: the only Python worker is the k x k solve of the regression,
which sees one small array per series.
"""

__version__ = "0.1.0"

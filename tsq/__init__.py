"""tsq: time-series and text data work as plain Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` built from the
DataFrame / SQL API, so Catalyst plans the work and the same code runs on
``local[8]`` and on a large cluster.  Sub-packages:

* ``tsq.sources``   readers for the input tables, file formats and profiles
* ``tsq.functions`` column expressions (calendar features, hash random
  numbers, safe arithmetic, date repair, text helpers)
* ``tsq.operators`` table operators (indexing, windows, features, scaling,
  decomposition, spectra, metrics, anomaly, similarity, augmentation,
  forecasting, text alignment)
* ``tsq.plans``     the registered queries and their SQL oracles
* ``tsq.streaming`` Structured Streaming versions of the core operators
"""

__version__ = "0.1.0"

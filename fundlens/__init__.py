"""fundlens: a Spark-native engine for daily investment-fund panels.

Layers:

* ``sources``   – landed-file scans, typed schemas, sinks, and the stand-in
                  adapter that derives fund data from the driver tables.
* ``functions`` – column-expression helpers (text, dates, numbers, keys).
* ``operators`` – DataFrame -> DataFrame building blocks (panel cleaning,
                  rolling returns, universe screens, statistics, clustering,
                  forecasting).
* ``plans``     – composed queries (dashboard, report, forecast) and the
                  registry used by ``__spark_entry__``.
* ``streaming`` – incremental landing of new daily reports.

Everything is lazy DataFrame / Spark SQL; nothing is pulled to the driver
except scalar parameters (a cut-off date, a chosen configuration id).
"""

__version__ = "0.1.0"

"""assetlens: asset-register and achievement-sheet analytics on Spark.

Packages: ``sources`` (scans and sinks), ``functions`` (Column
expressions), ``operators`` (DataFrame -> DataFrame operators), ``plans``
(composite jobs and table bindings), ``streaming`` (continuous ingest).
"""

__version__ = "0.1.0"

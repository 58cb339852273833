"""strata: cohort preparation, scoring and evaluation on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or a small
driver-side value derived from a one-row aggregate), composable through
``df.transform``.  Sub-packages:

* ``sources``   – readers, writers, fixture views over the given tables
* ``functions`` – column-expression builders (cleaning, hashing, prefix sums)
* ``operators`` – metrics, bootstrap, cascade, profiling, encoding,
                  imputation, training, calibration, explanation
* ``plans``     – end-to-end jobs and the query registry
* ``streaming`` – the narrow scoring operators on a streaming DataFrame
"""

__version__ = "0.1.0"

"""arlens: annual-report analytics as Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
column expressions, joins, windows and aggregates.  Sub-packages:

* ``sources``   - table readers, the report-file scan, the ledger CSV and the
                  fixtures that derive test inputs from the driver's tables.
* ``functions`` - reusable column expressions (text tests, t-tail p-values,
                  the unrolled linear solve).
* ``operators`` - the relational operators (resolve, regression, layout,
                  boilerplate, fonts, headings, html, tables, scoring, results).
* ``plans``     - compositions (report row, document sections), join helpers,
                  the query registry and the DuckDB oracles.
* ``streaming`` - incremental maintenance of stored results (anti-join skip,
                  insert-if-absent) usable from batch or ``foreachBatch``.
"""

__all__ = ["session"]

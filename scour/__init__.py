"""scour: table preparation on Spark.

Read tables from files, JDBC databases and object listings; clean them with
composable DataFrame operators; copy and verify tables; apply keyed changes;
query and redact audit logs.  Every operator is ``DataFrame -> DataFrame`` and
planned by Catalyst.
"""

__version__ = "0.1.0"

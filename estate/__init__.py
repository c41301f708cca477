"""estate: a data platform analysed as data, on Spark.

Catalog snapshots, query logs, grants, role memberships, model runs, ingestion
state, BI users and resource metrics come in as DataFrames; every operator
returns a DataFrame.  Nothing here talks to the systems described.
"""

__version__ = "0.1.0"

"""What the driver registers: the operators and the pipeline over the documents."""

import corpus_pipeline
from estate.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLE = {**queries.ORACLE, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}

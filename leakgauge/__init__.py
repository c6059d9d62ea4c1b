"""leakgauge: contamination analytics for benchmarks and training corpora on Spark.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and sinks), ``plans`` (named queries with their
SQL twins), ``streaming`` (ledger streams) and ``llm`` (operators for
training text; nothing else imports it).
"""

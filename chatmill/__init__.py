"""Chat fine-tuning data curation and evaluation as Spark jobs.

Every job takes DataFrames and returns DataFrames; see ``chatmill.plans`` for
the jobs and ``chatmill.operators`` / ``chatmill.functions`` for their stages.
"""

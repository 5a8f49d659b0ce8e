"""Document analytics as Spark jobs: matching, chaining, redaction and rule-based rewriting over tables."""

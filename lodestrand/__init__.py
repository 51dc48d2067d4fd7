"""Evidence-graph retrieval and set-based evaluation as PySpark DataFrame transformations."""

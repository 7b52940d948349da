"""quarry: Spark-native data work for building and evaluating QA datasets and
model predictions (cleaning, example building, scoring, metrics, inferential
statistics, experiment-catalog queries)."""

__version__ = "0.1.0"

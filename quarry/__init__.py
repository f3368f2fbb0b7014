"""An analytics engine for document corpora on Spark."""

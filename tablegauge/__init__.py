"""Spark operators that prepare labelled tables, measure their difficulty and evaluate classifiers."""

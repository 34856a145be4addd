"""Spark-native analytics over recognised documents: layout, questions, answers, mapping, grading."""

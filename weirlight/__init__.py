"""Spark-first analytics for collections of finite multivariate streams."""

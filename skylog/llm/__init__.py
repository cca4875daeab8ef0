"""Operators for preparing training text at corpus scale, each as Spark jobs."""

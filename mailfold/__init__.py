"""mailfold: job-application histories from mail archives, as Spark DataFrame jobs."""

__version__ = "0.1.0"

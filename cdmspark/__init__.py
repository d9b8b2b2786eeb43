"""cdmspark: bring many tenants' sales files into one common data model with Spark."""

__version__ = "0.1.0"

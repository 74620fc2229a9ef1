"""Binary files as Spark data sources."""

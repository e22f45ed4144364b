"""Membership-portfolio analytics expressed as Spark DataFrame operations."""

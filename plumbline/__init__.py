"""Plumbline: analytics over posts, users and interactions, written as Spark DataFrame programs."""

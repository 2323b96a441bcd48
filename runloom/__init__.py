"""Runloom: agent-usage analytics and corpus preparation as Spark jobs."""

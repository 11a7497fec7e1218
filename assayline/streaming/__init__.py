"""Structured Streaming forms: watching files, alerts, digests, approvals, deliveries.

Stateless steps are the batch functions applied to a streaming DataFrame.  Steps
that remember something keep it in Spark state or in a table partitioned by batch
id, so a batch that is run again after a failure writes the same result.
"""

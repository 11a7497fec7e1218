"""assayline: security-evidence analytics as plain Spark DataFrame jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing here runs an action, collects rows to the driver, or keeps
state outside Spark, so each function composes into one Catalyst plan.
"""

__version__ = "0.1.0"

"""Agent-traffic analytics as Spark jobs.

Every public function takes DataFrames and returns a DataFrame; nothing in the
package collects data to the driver beyond single statistics rows.
"""

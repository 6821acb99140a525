"""evenkeel: fairness analytics as Spark DataFrame operators.

Every operator takes DataFrames (plus an audit spec) and returns a
DataFrame; the heavy lifting is expressed with the DataFrame API so that
Catalyst prunes columns, pushes filters to the scan and turns every
group-wise statistic into a partial (map-side) aggregation.
"""

from evenkeel.spec import AuditSpec, FairnessThresholds, DetectionThresholds

__all__ = ["AuditSpec", "FairnessThresholds", "DetectionThresholds"]

"""aislewise: retail-panel analytics as PySpark DataFrame operators."""

"""Point-in-time panel analytics on PySpark: functions from DataFrame to DataFrame."""

"""Call-risk analytics on PySpark: windows, scoring, fusion, alerts, audit and metrics as DataFrame operators."""

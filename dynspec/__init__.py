"""Dynamic-spectrum analytics on Spark."""

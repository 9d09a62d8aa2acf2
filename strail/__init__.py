"""strail: labelled movement data on Spark."""

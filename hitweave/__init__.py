"""Track finding and graph analytics over collections of events, written for Spark."""

"""Spark-native text-to-geodata engine: cleaning, matching, resolution, geography, chronicle and gates as DataFrame jobs."""

"""Spark-native analytics for dated corporate events.

`functions`  column expressions (dates, text, priors, scoring, buckets)
`operators`  DataFrame -> DataFrame building blocks (as-of joins, panels, point-in-time state)
`sources`    readers that turn landed files into typed DataFrames
`plans`      composed queries (calendar, board, outcomes, logs, studies, refresh)
"""

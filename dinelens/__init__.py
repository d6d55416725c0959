"""dinelens: food-order analytics (staging, marts, dashboards, review
pipelines) as Spark DataFrame jobs."""

__version__ = "0.1.0"

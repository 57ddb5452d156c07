"""Region, time-course and reporter-assay analytics as lazy Spark DataFrame operators."""

"""tidyshelf: product-catalogue cleaning and data quality on Spark.

Every operator is a plain function from DataFrame to DataFrame or from Column
to Column. ``""`` means "missing" for text and ``row_idx`` is the identity of a
row from the raw scan to the reports.
"""

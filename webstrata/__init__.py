"""webstrata: analytics over collections of archived web pages, as Spark DataFrame operators."""

"""A text-corpus analytics engine written as DataFrame and Spark SQL plans."""

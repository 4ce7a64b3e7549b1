"""Text, vector and media operators for preparing training corpora on Spark.

Nothing outside this subpackage imports it.
"""

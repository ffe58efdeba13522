"""Record linkage and large-table analytics on PySpark."""

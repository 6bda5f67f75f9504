"""factloom: a PySpark-native engine for claims that change over time and for the text they come from."""

"""arbora: a PySpark-native analytics engine for directed follow graphs and the text and profile data around them."""

"""A Spark-native audit engine for collections of web pages."""

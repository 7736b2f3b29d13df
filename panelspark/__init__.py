"""PySpark-native analytics over dated panels of securities."""

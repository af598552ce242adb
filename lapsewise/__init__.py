"""Time-to-event analytics over tables with free text, as Spark DataFrame operators."""

"""Sources and sinks: serialized archives as a Spark data source, and text files by line."""

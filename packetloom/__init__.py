"""packetloom: transport-stream and ordered-sequence analytics as Spark DataFrame plans."""

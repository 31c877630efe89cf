"""Part of the detection-event analytics library."""

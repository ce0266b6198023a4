"""Learning-event analytics on Spark: point-in-time features, encoders, replay simulation and models."""

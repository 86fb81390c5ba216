"""Interaction analytics on Spark: cleaning, histories, interests, replay and statistics."""

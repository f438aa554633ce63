"""Streaming entry points: odometry with state, keyframe counts, event windows."""

"""Readers and writers of scan, label, pose and calibration files and of message buffers."""

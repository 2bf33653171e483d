"""Readers and writers of tracklogs, tasks and waypoints."""

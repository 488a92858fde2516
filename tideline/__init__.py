"""Tideline: interval, story-plan and document analytics expressed as Spark jobs."""

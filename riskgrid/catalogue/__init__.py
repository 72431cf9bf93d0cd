"""Registered queries by area, each with its oracle SQL."""

"""Readers and writers of the tables that the stages exchange."""

"""Stateful operators on event streams, each with its batch form."""

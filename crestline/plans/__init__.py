"""Registered queries over the fixture tables, each with its SQL check where SQL can say it."""

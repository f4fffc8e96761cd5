"""Readers of conversation datasets: turns and questions of one form."""

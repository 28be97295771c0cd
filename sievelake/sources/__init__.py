"""Readers that turn feeds (JSON, RSS, HTML, CSV, mail) into rows of one posting schema."""

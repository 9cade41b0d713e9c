"""Readers for the stored inputs."""

"""Readers and writers of panel inputs."""

"""Readers and writers of station archives, model fields and products."""

"""Operators over long tables of stations, cells and months."""

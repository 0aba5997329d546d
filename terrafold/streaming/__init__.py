"""Frames that arrive one after the other."""

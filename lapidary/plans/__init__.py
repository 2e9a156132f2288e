"""Fitted plans: profile, compile, apply."""

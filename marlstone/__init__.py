"""Marlstone: typed object models and method-chain programs, planned by Catalyst."""

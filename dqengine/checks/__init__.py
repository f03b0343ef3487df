"""Registered queries and the SQL each is checked with."""

from dqengine.checks import auditing, healing, history, monitoring, planning, profiling, sourcing, streams

ALL_MODULES = (sourcing, profiling, planning, healing, auditing, history, monitoring, streams)

"""Queries by name; importing this package registers all of them."""

from quillon.plans import dashboard, evaluation, events, files, governance, packages, policy, releases, reports, scoring, scripts, signals, typosquat  # noqa: F401

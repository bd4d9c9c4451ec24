"""Streams over the register change log, each with a batch twin."""

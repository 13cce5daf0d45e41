"""Errors that a user can mend."""


class InputError(Exception):
    """Bad input, policy or option; exit code 2. Other errors are internal, exit code 3."""

    exit_code = 2

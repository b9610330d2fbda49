"""Where intermediate tables go: the shared folder the session names."""

from urlvane.functions.scratch import shared_folder

__all__ = ["shared_folder"]

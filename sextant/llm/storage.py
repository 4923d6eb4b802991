"""Where this subpackage keeps what it writes on the way."""

from sextant.storage import cut, discard, shared_folder

__all__ = ["cut", "discard", "shared_folder"]

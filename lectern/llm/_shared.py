"""The library's shared storage, under the names that the operators use."""

from lectern.storage import new_path, shared_dir, stored

__all__ = ["new_path", "shared_dir", "stored"]

"""Intermediate tables of the training-data operators, in the folder that driver and executors share."""

from chronolake.sources.staging import new_path, removed
from chronolake.sources.staging import staged as written
from chronolake.sources.staging import staged_at as written_at
from chronolake.sources.staging import staging_folder as folder

__all__ = ["folder", "new_path", "removed", "written", "written_at"]

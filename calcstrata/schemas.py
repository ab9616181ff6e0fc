"""Schemas of the stored tables."""

from __future__ import annotations

BLOBS = "blob_hash string, content binary, size_bytes bigint"
FILE = "struct<blob_hash:string,file_type:string,is_reference:boolean,path:string,size_bytes:bigint>"
COMMITS = f"commit_hash string, parent_hash string, timestamp string, author string, message string, environment map<string,string>, files array<{FILE}>"
STAGED = "path string, blob_hash string, size_bytes bigint, mtime string, file_type string"
DIFFS = "commit_hash string, file string, file_type string, ord int, path string, old_value string, new_value string, change_type string, significance string, parse_error boolean"
OUTPUT = "commit_hash string, total_energy double, is_converged boolean, ionic_steps int, max_force double, warnings string"

#: Fixed value: version of the stored layout and of the staging index.
VERSION = 1


class RepositoryError(Exception):
    """A repository operation cannot be carried out."""


class BlobNotFoundError(RepositoryError):
    """No blob has this hash."""


class BlobCorruptedError(RepositoryError):
    """A blob's bytes do not have its hash."""


class StagingError(RepositoryError):
    """Files cannot be staged."""

"""Files in the shared folder of the session, opened by URI from any task.

Tasks write under a name of their own and hand the names back as rows, so a file that a lost or repeated task
left behind is in no manifest and never read.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from abundix.session import stage_path


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below ``spark.checkpoint.dir``."""
    path = stage_path(spark, name)
    folder = path if ":/" in path else f"file://{path}"
    system, place = pafs.FileSystem.from_uri(folder)
    system.create_dir(place, recursive=True)
    return folder


def new_name(folder: str, stem: str, ending: str) -> str:
    return f"{folder}/{stem}-{uuid.uuid4().hex}{ending}"


def create(uri: str) -> pa.NativeFile:
    system, place = pafs.FileSystem.from_uri(uri)
    return system.open_output_stream(place, compression=None)


def read(uri: str) -> pa.Buffer:
    """The whole of a file whose size the writer has bounded."""
    system, place = pafs.FileSystem.from_uri(uri)
    with system.open_input_file(place) as source:
        return source.read_buffer()


def open_at(uri: str) -> pa.NativeFile:
    """A seekable file, for readers that need only parts."""
    system, place = pafs.FileSystem.from_uri(uri)
    return system.open_input_file(place)

"""Opening one file inside a task."""

from __future__ import annotations

import re
import sys
from urllib.parse import quote

from pyspark import cloudpickle


def hadoop_path(path: str) -> str:
    """A path as Spark lists it, for a reader that takes patterns: characters of patterns stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def open_file(path: str):
    """A seekable binary file at a path as Spark lists it: nothing in it is percent-encoded.

    Any address Arrow knows will do (local, HDFS, object stores).
    """
    from pyarrow import fs

    scheme, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]+):)?(.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem().open_input_file(re.sub("^//+", "/", rest))
    filesystem, found = fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@=+,;$&!*~()')}")
    return filesystem.open_input_file(found)


# Tasks get the functions above with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

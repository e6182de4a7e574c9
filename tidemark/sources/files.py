"""Small text files in the store's folder, by Hadoop's file systems through the session: any scheme Spark reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from tidemark.errors import UserInputError


#: Schemes of file systems where a file appears when it is closed, and renaming copies.
OBJECT_STORES = ("s3a", "s3", "gs", "wasb", "wasbs", "oss", "cosn")


def own_folder(spark: SparkSession, prefix: str) -> str:
    """A folder for this session: in the shared folder that ``spark.checkpoint.dir`` names, or, in a local session, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{prefix}{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise UserInputError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


class Folder:
    """Files below a root, by relative names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.objects = self.fs.getScheme() in OBJECT_STORES

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        out = self.fs.create(self._path(name), overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def create(self, name: str, text: str) -> bool:
        """A new file, whole or not at all; False if the name is taken.

        Object stores have no renaming, but a file there is whole once its stream is closed.
        """
        if self.exists(name):
            return False
        if self.objects:
            try:
                self._write(name, text, False)
            except Py4JJavaError as e:
                if "FileAlreadyExists" in e.java_exception.getClass().getName():
                    return False
                raise
            return True
        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        self._write(draft, text, False)
        ok = not self.exists(name) and self.fs.rename(self._path(draft), self._path(name))
        if not ok:
            self.fs.delete(self._path(draft), False)
        return ok

    def put(self, name: str, text: str) -> None:
        """A file, replacing one of that name at once: readers see the old one or the new one."""
        if self.objects:
            self._write(name, text, True)
            return
        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        self._write(draft, text, False)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(self._path(draft), self._path(name), options)

    def names(self, name: str = "") -> list[str]:
        """Names of files and folders in a folder, sorted."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name)) if not s.getPath().getName().endswith(".tmp"))

    def sizes(self, name: str) -> dict[str, int]:
        """Bytes of the files in a folder."""
        if not self.exists(name):
            return {}
        return {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self._path(name)) if s.isFile()}

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def delete_path(self, path: str) -> None:
        """Deletes a folder by its full path."""
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(path), True)

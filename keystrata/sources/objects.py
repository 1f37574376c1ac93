"""Small objects in a folder of any Hadoop file system: exclusive create, read, list.

An object is there with all of its bytes or not at all. Object stores publish an object when its upload
ends; on file systems it is written beside under a hidden name and then moved to its own, which fails if
that is taken. A writer that dies on the way leaves a hidden file that nobody reads.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import SparkSession

#: Schemes whose objects appear whole when the upload ends.
STORES = ("s3a", "s3", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cosn")


class AlreadyExists(Exception):
    """The object to be created is there already: another writer won."""


class Torn(ValueError):
    """An object whose content does not match its checksum."""


class ObjectFolder:
    """Driver-side access to the small control objects of a table (manifests, commits)."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._base = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._base.getFileSystem(self._conf)
        self._scheme = self._fs.getUri().getScheme()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def create(self, name: str, text: str) -> None:
        """Create an object; ``AlreadyExists`` if the name is taken. The file system decides atomically."""
        try:
            if self._scheme in STORES:
                self._put(self._fs.createFile(self._at(name)).overwrite(False).opt("fs.option.create.conditional.overwrite", True).build(), text)
                return
            aside = self._at(f".{name}.{uuid.uuid4().hex}")
            self._put(self._fs.create(aside, False), text)
            try:
                if self._scheme == "file":  # a link is made only if its name is free, a move would replace
                    local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                    self._jvm.java.nio.file.Files.createLink(local(self._at(name)), local(aside))
                else:
                    context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._base.toUri(), self._conf)
                    self._move(context, aside, name)
            finally:
                self._fs.delete(aside, False)
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error) or "PreconditionFailed" in str(error) or "412" in str(error)[:200]:
                raise AlreadyExists(name) from None
            raise

    def _move(self, context, aside, name: str) -> None:
        """Rename without replacing: the name system of the file system decides."""
        kinds = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self._jvm.java.lang.reflect.Array.newInstance(kinds, 0)
        context.rename(aside, self._at(name), options)

    def _put(self, out, text: str) -> None:
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self) -> list[str]:
        if not self._fs.exists(self._base):
            return []
        return sorted(n for s in self._fs.listStatus(self._base) if s.isFile() and not (n := s.getPath().getName()).startswith("."))


def sealed(body: str) -> str:
    """A text with its checksum in front."""
    return f"{zlib.crc32(body.encode()):08x}\n{body}"


def unsealed(text: str) -> str:
    """The text behind a checksum; ``Torn`` if it does not match."""
    head, _, body = text.partition("\n")
    if head != f"{zlib.crc32(body.encode()):08x}":
        raise Torn("checksum mismatch")
    return body

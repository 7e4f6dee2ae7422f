"""Small files and folders beside the tables, through Hadoop's file systems: local, mounted or object stores alike."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """What snapshots, caches and run folders need of a file system; paths may carry any scheme that Spark reads."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        """What lies directly in a folder, sorted; nothing where there is none."""
        fs, p = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, source: str, target: str) -> None:
        """Renames; the target must not exist."""
        (fs, a), (_, b) = self._at(source), self._at(target)
        if fs.exists(b) or not fs.rename(a, b):
            raise FileExistsError(target)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def join(*parts: str) -> str:
    return "/".join([parts[0].rstrip("/"), *parts[1:]])

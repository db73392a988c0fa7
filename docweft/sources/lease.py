"""One writer at a time on a shared folder, by files that only one process can create.

A lease is a row of numbered files.  The holder of the largest number holds the lease until
it writes ``.done`` beside it; it shows that it lives by touching ``.beat``.  Once the
largest number is done, or has not been touched for ``ttl`` seconds, anybody may create
the next number, and of several only one can.  Numbers only grow, so a holder that was
held up and replaced sees a larger number than its own, and must not commit.  Times are
those of the file system, never of this machine.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class LostLease(RuntimeError):
    """Another process has taken the place of this one."""


class Folder:
    """Small files of a folder, through the session's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._at(""))
        self.local = self.fs.getScheme() == "file"

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def created(self, name: str) -> bool:
        """Whether this call made the file; of calls at the same time one does."""
        try:
            if self.local:  # whose Hadoop client looks first and then creates
                return self.jvm.java.io.File(self._at(name).toUri().getPath()).createNewFile()
            self.fs.create(self._at(name), False).close()
            return True
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise

    def touch(self, name: str) -> int:
        """Make or renew a file; its time in milliseconds."""
        self.fs.create(self._at(name), True).close()
        return self.time(name)

    def time(self, name: str) -> int:
        return self.fs.getFileStatus(self._at(name)).getModificationTime() if self.fs.exists(self._at(name)) else 0

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at("")))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), False)


class Lease:
    """``held`` tells whether this process got the lease; used as a context it is given back at the end."""

    def __init__(self, spark: SparkSession, top: str, ttl: float = 60.0):
        self.folder, self.ttl = Folder(spark, f"{top}/lease"), ttl
        self.token: int | None = None
        self.ended = threading.Event()

    def _newest(self) -> int:
        return max([0, *(int(n) for n in self.folder.names() if n.isdigit())])

    def _free(self, number: int) -> bool:
        name = f"{number:012d}"
        if not number or self.folder.exists(f"{name}.done"):
            return True
        probe = f"now-{uuid.uuid4().hex}"
        now = self.folder.touch(probe)
        self.folder.delete(probe)
        return now - max(self.folder.time(name), self.folder.time(f"{name}.beat")) > 1000 * self.ttl

    def acquire(self) -> bool:
        number = self._newest()
        if not self._free(number) or not self.folder.created(f"{number + 1:012d}"):
            return False
        self.token = number + 1
        threading.Thread(target=self._beat, daemon=True).start()
        return True

    def _beat(self) -> None:
        while not self.ended.wait(self.ttl / 4):
            self.folder.touch(f"{self.token:012d}.beat")

    def check(self) -> None:
        """To be called just before a commit."""
        if self.token is None or self._newest() != self.token:
            raise LostLease(f"lease {self.token} of {self.folder.path} was taken over")

    def release(self) -> None:
        self.ended.set()
        self.folder.touch(f"{self.token:012d}.done")
        for name in self.folder.names():  # what older holders left
            if name.split(".")[0].isdigit() and int(name.split(".")[0]) < self.token:
                self.folder.delete(name)


def serialised(spark: SparkSession, top: str, run: Callable[[Callable[[], None]], str], ttl: float = 60.0) -> list[str]:
    """Have ``run(check)`` done at least once after this call began, by one process at a time; the results of the runs made here.

    Each call leaves a request.  Whoever gets the lease takes the requests that are there,
    runs, and only then deletes them; what was requested meanwhile makes one more run.  A
    call that does not get the lease returns at once: the holder looks for requests once
    more after it has given the lease back.  ``run`` calls ``check`` before it commits.
    """
    requests = Folder(spark, f"{top}/requests")
    requests.touch(uuid.uuid4().hex)
    done = []
    while taken := requests.names():
        lease = Lease(spark, top, ttl)
        if not lease.acquire():
            break
        try:
            done.append(run(lease.check))
            for name in taken:
                requests.delete(name)
        finally:
            lease.release()
    return done

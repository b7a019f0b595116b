"""Archives of run artefacts, and their mirror in any store that Spark reads. Small driver-side files, not tables."""

from __future__ import annotations

import hashlib
import os
import zipfile
from collections.abc import Mapping

from pyspark.sql import SparkSession

#: Member that lists the others with their SHA-256; the largest archive; the file that marks a mirrored folder as whole.
SUMS, LARGEST, WHOLE = "SHA256SUMS", 5 << 30, "_WHOLE"
_PART = 1 << 20


def _sum(stream) -> str:  # noqa: ANN001
    found = hashlib.sha256()
    while part := stream.read(_PART):
        found.update(part)
    return found.hexdigest()


def write_archive(members: Mapping[str, str], path: str, most: int = LARGEST) -> dict[str, str]:
    """A ZIP of local files by member name, with their SHA-256 as a member; written beside and moved once it is verified. Returns the sums; raises beyond ``most`` bytes."""
    if SUMS in members or not members:
        raise ValueError(f"members are named, and none is {SUMS}")
    if sum(os.path.getsize(p) for p in members.values()) > most:
        raise ValueError(f"members are larger than {most} bytes")
    sums, beside = {}, f"{path}.new"
    with zipfile.ZipFile(beside, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, source in sorted(members.items()):
            with open(source, "rb") as file:  # an artefact of the driver's, not an input table
                sums[name] = _sum(file)
            archive.write(source, name)
        archive.writestr(SUMS, "".join(f"{x}  {name}\n" for name, x in sorted(sums.items())))
    verify_archive(beside, most)
    os.replace(beside, path)
    return sums


def verify_archive(path: str, most: int = LARGEST) -> dict[str, str]:
    """The sums of an archive's members; raises if it is too large, a member repeats, is corrupt, unlisted or missing, or differs from its sum."""
    if os.path.getsize(path) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    with zipfile.ZipFile(path) as archive:
        names = archive.namelist()
        if len(set(names)) != len(names):
            raise ValueError("a member repeats")
        if (bad := archive.testzip()) is not None:
            raise ValueError(f"{bad} is corrupt")
        if SUMS not in names:
            raise ValueError(f"{SUMS} is missing")
        sums = {name: x for x, _, name in (line.partition("  ") for line in archive.read(SUMS).decode().splitlines())}
        if set(sums) | {SUMS} != set(names):
            raise ValueError("members and sums do not match")
        for name, x in sums.items():
            with archive.open(name) as member:
                if _sum(member) != x:
                    raise ValueError(f"{name} differs from its sum")
    return sums


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def push(spark: SparkSession, folder: str, mirror: str, name: str, keep: int = 2) -> None:
    """A local folder copied to ``mirror/name``, its files first and the mark of being whole last; of whole copies the ``keep`` last by name stay."""
    store, at = _store(spark, mirror)
    target = f"{mirror.rstrip('/')}/{name}"
    store.delete(at(target), True)
    store.mkdirs(at(target))
    for file in sorted(os.listdir(folder)):
        store.copyFromLocalFile(False, True, at(f"file://{os.path.abspath(folder)}/{file}"), at(f"{target}/{file}"))
    store.create(at(f"{target}/{WHOLE}")).close()
    for old in whole(spark, mirror)[:-keep]:
        store.delete(at(f"{mirror.rstrip('/')}/{old}"), True)


def whole(spark: SparkSession, mirror: str) -> list[str]:
    """Names of the whole copies, in order."""
    store, at = _store(spark, mirror)
    if not store.exists(at(mirror)):
        return []
    names = [x.getPath().getName() for x in store.listStatus(at(mirror)) if x.isDirectory()]
    return sorted(n for n in names if store.exists(at(f"{mirror.rstrip('/')}/{n}/{WHOLE}")))


def pull(spark: SparkSession, mirror: str, folder: str) -> str | None:
    """The newest whole copy brought to a local folder, without its mark; returns its name, none if there is none."""
    names = whole(spark, mirror)
    if not names:
        return None
    store, at = _store(spark, mirror)
    os.makedirs(folder, exist_ok=True)
    for x in store.listStatus(at(f"{mirror.rstrip('/')}/{names[-1]}")):
        if x.getPath().getName() != WHOLE:
            store.copyToLocalFile(False, x.getPath(), at(f"file://{os.path.abspath(folder)}/{x.getPath().getName()}"), True)
    return names[-1]
